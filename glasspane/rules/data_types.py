"""Personal-data categories: what each one is, and the words that reveal it."""

# Category id, label, sensitivity, special category (Art. 9), GDPR article, CCPA category.
CATEGORIES = (
    ("health", "Health & Medical Data", "critical", True, "Art. 9(2)", "Sensitive Personal Information"),
    ("biometric", "Biometric Data", "critical", True, "Art. 9(2)(e)", "Sensitive Personal Information"),
    ("genetic", "Genetic Data", "critical", True, "Art. 9(2)(e)", "Sensitive Personal Information"),
    ("racial_ethnic", "Racial / Ethnic Origin", "critical", True, "Art. 9(2)(a)", "Sensitive Personal Information"),
    ("political_opinions", "Political Opinions", "critical", True, "Art. 9(2)(a)", "Sensitive Personal Information"),
    ("religious_beliefs", "Religious / Philosophical Beliefs", "critical", True, "Art. 9(2)(a)",
     "Sensitive Personal Information"),
    ("sexual_orientation", "Sexual Orientation / Sex Life", "critical", True, "Art. 9(2)(a)",
     "Sensitive Personal Information"),
    ("trade_union", "Trade Union Membership", "critical", True, "Art. 9(2)(a)", "Sensitive Personal Information"),
    ("government_id", "Government Identifiers", "high", False, "Art. 87 (national IDs)",
     "Sensitive Personal Information"),
    ("financial", "Financial & Payment Data", "high", False, "Art. 4(1)", "Sensitive Personal Information"),
    ("precise_location", "Precise Location Data", "high", False, "Art. 4(1)", "Sensitive Personal Information"),
    ("communications", "Communications Content", "high", False, "Art. 4(1) + ePrivacy", "Personal Information"),
    ("children_data", "Children's Data", "high", False, "Art. 8 GDPR / COPPA (US)", "Sensitive Personal Information"),
    ("inferences", "Inferences & Profiling", "high", False, "Art. 22 GDPR", "Inferences"),
    ("identity", "Identity Data", "medium", False, "Art. 4(1)", "Identifiers"),
    ("contact", "Contact Information", "medium", False, "Art. 4(1)", "Identifiers"),
    ("behavioral", "Behavioral & Usage Data", "medium", False, "Art. 4(1)",
     "Internet or other electronic network activity"),
    ("social_connections", "Social Connections", "medium", False, "Art. 4(1)", "Personal Information"),
    ("user_content", "User-Generated Content", "medium", False, "Art. 4(1)", "Inferences"),
    ("approximate_location", "Approximate Location", "medium", False, "Art. 4(1)", "Geolocation Data"),
    ("device", "Device & Technical Data", "low", False, "Art. 4(1)", "Identifiers"),
    ("professional", "Professional Information", "low", False, "Art. 4(1)",
     "Professional or employment-related information"),
    ("preferences", "Preferences & Interests", "low", False, "Art. 4(1)", "Inferences"),
)

# Keywords per category, in the order in which they are looked for.
KEYWORDS = {
    "health": ("health", "medical", "health data", "medical history", "diagnosis", "treatment", "prescription",
               "medication", "clinical", "patient", "disease", "condition", "disability", "mental health",
               "psychiatric", "psychological", "therapy", "healthcare", "wellness", "fitness data", "body weight",
               "blood pressure", "heart rate", "sleep data"),
    "biometric": ("biometric", "fingerprint", "facial recognition", "face recognition", "retina scan", "iris scan",
                  "voice recognition", "voice print", "palm print", "gait recognition", "keystroke dynamics",
                  "behavioral biometrics", "biometric identifier"),
    "genetic": ("genetic", "dna", "genome", "genomic", "genetic data", "genetic testing", "ancestry", "hereditary"),
    "racial_ethnic": ("race", "racial", "ethnic", "ethnicity", "ethnic origin", "national origin", "racial origin"),
    "political_opinions": ("political opinion", "political belief", "political affiliation", "political views",
                           "party membership", "voting"),
    "religious_beliefs": ("religion", "religious belief", "philosophical belief", "faith", "religious affiliation",
                          "church", "denomination"),
    "sexual_orientation": ("sexual orientation", "sex life", "sexual life", "sexuality", "gender identity", "lgbtq"),
    "trade_union": ("trade union", "labor union", "union membership", "union member"),
    "government_id": ("social security", "ssn", "passport", "driver's license", "national id", "tax id", "ein",
                      "government id", "national insurance", "voter id", "state id"),
    "financial": ("credit card", "debit card", "payment", "bank account", "billing", "financial", "bank details",
                  "transaction", "purchase history", "payment method", "iban", "swift", "credit score",
                  "financial information"),
    "precise_location": ("precise location", "gps", "geolocation", "real-time location", "coordinates", "latitude",
                         "longitude", "location tracking", "location data", "location history", "whereabouts"),
    "communications": ("message content", "email content", "chat history", "inbox", "private messages",
                       "direct messages", "communications", "correspondence", "conversation"),
    "children_data": ("children", "child", "minor", "under 13", "under 16", "parental consent", "coppa", "kids",
                      "under age"),
    "inferences": ("inferences", "profiling", "profile", "automated decision", "automated processing", "scoring",
                   "predictions", "behavioral profiling", "interest-based advertising"),
    "identity": ("name", "full name", "first name", "last name", "username", "user id", "account name",
                 "display name", "real name", "identity", "date of birth", "age", "gender"),
    "contact": ("email address", "phone number", "address", "postal code", "zip code", "telephone", "mobile number",
                "street address", "home address", "mailing address", "contact information"),
    "behavioral": ("browsing history", "search history", "usage data", "activity data", "interaction data",
                   "clickstream", "page views", "session data", "log data", "access logs", "behavioral data"),
    "social_connections": ("contacts", "friends list", "connections", "followers", "social graph", "address book",
                           "social network", "contact list", "people you follow"),
    "user_content": ("content you post", "user content", "reviews", "comments", "uploads", "photos", "videos",
                     "posts", "user-generated"),
    "approximate_location": ("ip address location", "general location", "city", "region", "country",
                             "approximate location", "geographic region"),
    "device": ("ip address", "device", "browser type", "operating system", "hardware", "device id",
               "cookie identifier", "device fingerprint", "user agent", "screen resolution", "time zone", "language"),
    "professional": ("employer", "job title", "company", "workplace", "occupation", "professional information",
                     "work experience", "skills", "education", "degree", "university"),
    "preferences": ("preferences", "interests", "settings", "favorites", "wishlist", "recommendations",
                    "personalization"),
}

# Collection phrases per category (regular expressions over lower-cased text).
PHRASES = {
    "health": (r"collect\w* (?:your |health |medical )?(?:health|medical)", r"health(?:care)? (?:information|data)",
               r"medical (?:information|data|records|history)"),
    "biometric": (r"biometric(?:\s+data|\s+information|\s+identifier)?", r"facial\s+recognition",
                  r"fingerprint(?:\s+data)?"),
    "genetic": (r"genetic\s+(?:data|information|testing)",),
    "racial_ethnic": (r"racial\s+or\s+ethnic\s+origin",),
    "political_opinions": (r"political\s+(?:opinion|belief|affiliation)",),
    "religious_beliefs": (r"religious\s+or\s+philosophical\s+beliefs",),
    "sexual_orientation": (r"sexual\s+(?:orientation|life)",),
    "trade_union": (r"trade\s+union\s+membership",),
    "government_id": (r"social\s+security\s+number", r"passport\s+number", r"driver.s\s+licen[sc]e"),
    "financial": (r"payment\s+(?:information|data|details)", r"bank\s+account", r"credit\s+card"),
    "precise_location": (r"precise\s+(?:geo)?location", r"gps\s+(?:data|coordinates)", r"real.time\s+location"),
    "communications": (r"content\s+of\s+(?:your\s+)?(?:messages|emails|communications)", r"private\s+messages"),
    "children_data": (r"children\s+under\s+\d+", r"minors", r"parental\s+consent"),
    "inferences": (r"inferences?\s+(?:drawn|made|about)", r"automated\s+decision.making", r"profiling"),
    "identity": (r"(?:collect|gather|receive)\s+your\s+(?:name|identity)", r"full\s+name"),
    "contact": (r"(?:email|phone|address)\s+(?:address|number)?", r"contact\s+information"),
    "behavioral": (r"browsing\s+(?:history|behavior|activity)", r"usage\s+(?:data|information|statistics)",
                   r"interaction\s+data"),
    "social_connections": (r"social\s+(?:graph|connections|network)", r"contact\s+list", r"friends\s+list"),
    "user_content": (r"content\s+(?:you|users?)\s+(?:post|upload|share|submit)", r"user.generated\s+content"),
    "approximate_location": (r"(?:city|region|country)\s+(?:level\s+)?location", r"approximate\s+location"),
    "device": (r"device\s+(?:information|identifier|data)", r"ip\s+address", r"browser\s+type"),
    "professional": (r"professional\s+(?:information|background)", r"employment\s+(?:information|history)"),
    "preferences": (r"your\s+preferences", r"interests\s+(?:and|or)\s+(?:preferences|activities)"),
}

# Phrases that say data is passed on, and how far from the evidence they may stand.
SHARING = (
    r"share\w* (?:your |this |such |that )?(?:personal |this )?(?:data|information|details)",
    r"disclose\w* (?:to )?(?:third.?part(?:y|ies)|partner|vendor|affiliate)",
    r"transfer\w* (?:your )?(?:personal |this )?(?:data|information) to",
    r"provid\w* (?:your )?(?:data|information) (?:to|with)",
    r"sell\w* (?:your )?(?:personal )?(?:data|information)",
)
SHARING_RADIUS = 300
KEYWORD_WINDOW = (80, 80)
PHRASE_WINDOW = (60, 120)
MAX_KEYWORDS = 2
MAX_EVIDENCE = 3

# Order of severity.
SENSITIVITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
