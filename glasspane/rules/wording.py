"""Wording of a policy: vague, hedged, specific, passive, accountable."""

# Vague quantifiers, hedges and purposes (substrings of lower-cased text).
VAGUE_TERMS = ("various", "certain", "some", "multiple", "other", "many", "numerous", "several", "a number of",
               "a variety of", "a range of", "similar", "relevant", "appropriate", "applicable", "related",
               "including but not limited to", "among other things", "inter alia", "such as", "for example",
               "as appropriate")
HEDGES = ("may", "might", "could", "sometimes", "in some cases", "in certain cases", "where applicable",
          "as necessary", "if required", "when necessary", "at our discretion", "at our sole discretion",
          "at any time", "from time to time", "as we deem", "as we see fit", "as determined by us",
          "in our sole judgment", "in our reasonable opinion")
VAGUE_PURPOSES = ("business purposes", "operational purposes", "internal purposes", "legitimate interests",
                  "legitimate business interests", "service improvement", "product development",
                  "analytical purposes", "marketing purposes", "commercial purposes", "administrative purposes",
                  "legal purposes", "research purposes", "statistical purposes")

# Purposes that say something.
SPECIFIC_PURPOSES = (
    r"in order to (?:provide|deliver|process|send|fulfill)",
    r"for the (?:purpose|purposes) of (?:providing|delivering|processing)",
    r"to (?:send you|deliver|process|complete|fulfill) (?:your )?(?:order|purchase|request)",
    r"to (?:verify|authenticate|confirm) (?:your )?(?:identity|account)",
    r"to (?:comply with|meet) (?:our )?(?:legal|regulatory) (?:obligations?|requirements?)",
    r"for (?:fraud\s+)?(?:detection|prevention) (?:and\s+)?(?:security)?",
)

# Well-known recipients (substrings), and the form of a legal entity's name (case matters).
KNOWN_NAMES = ("google analytics", "google ads", "google tag manager", "google llc", "meta", "facebook", "instagram",
               "twitter", "linkedin", "salesforce", "hubspot", "mailchimp", "klaviyo", "stripe", "paypal",
               "braintree", "square", "amazon web services", "aws", "cloudflare", "zendesk", "intercom", "drift",
               "mixpanel", "amplitude", "segment", "heap", "hotjar", "fullstory", "logrocket", "criteo",
               "doubleclick", "adroll", "microsoft", "apple", "adobe", "twilio", "sendgrid", "optimizely", "vwo")
ENTITY_FORMS = r"(?:Inc\.?|LLC\.?|Ltd\.?|Corp\.?|GmbH|S\.A\.|B\.V\.|AG|PLC|SE)"
ENTITY_LITERALS = ("Inc", "LLC", "Ltd", "Corp", "GmbH", "S.A.", "B.V.", "AG", "PLC", "SE")  # every form begins with one
LEGAL_ENTITY = rf"\b(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+{ENTITY_FORMS}\b"

# Passive and active phrases. "we share" is counted by two active patterns.
PASSIVE = (
    r"\bdata (?:may|might|could|will|is|are|was|were) (?:be )?"
    r"(?:shared|disclosed|transferred|sold|processed|collected|used)",
    r"\binformation (?:may|might|could|will|is|are|was|were) (?:be )?"
    r"(?:shared|disclosed|transferred|sold|processed|collected|used)",
    r"\byour (?:data|information|details) (?:may|might|could|will) (?:be )?",
    r"\b(?:may|might|could) (?:be )?shared",
    r"\b(?:may|might|could) (?:be )?disclosed",
    r"\b(?:may|might|could) (?:be )?transferred",
)
ACTIVE = (
    r"\bwe (?:share|disclose|transfer|sell|process|collect|use)\b",
    r"\bwe (?:do not|don'?t) (?:share|sell|disclose)\b",
    r"\b(?:we|our company|[a-z]+ (?:inc|llc|ltd)\.?) (?:share|disclose|transfer)\b",
)

# Accountability markers by group (lower case, see README on case).
ACCOUNTABILITY = {
    "dpo_named": (r"data protection officer", r"\bdpo\b", r"privacy officer", r"chief privacy officer"),
    "dpo_contact": (r"(?:contact|reach|email)\s+(?:our|the)\s+(?:data protection|privacy)\s+officer", r"dpo@",
                    r"privacy@"),
    "supervisory_authority": (r"supervisory authority", r"data protection authority", r"information commissioner",
                              r"\bico\b", r"\bcnil\b", r"\bgdpr\b.*complaint"),
    "legitimate_basis": (r"legal basis", r"lawful basis", r"legitimate interest",
                         r"consent (?:as the|is the) (?:legal|lawful) basis",
                         r"contractual (?:necessity|obligation)"),
    "privacy_by_design": (r"privacy by design", r"privacy by default", r"data minimization", r"data minimisation",
                          r"purpose limitation", r"storage limitation"),
    "security_measures": (r"encryption", r"ssl", r"tls", r"access controls?", r"pseudonym(?:iz|is)ation",
                          r"anonymiz(?:ation|ation)", r"iso 27001", r"soc 2"),
}

# Weights and cuts of the transparency measure.
VAGUE_WEIGHT = 4
SPECIFIC_WEIGHT = 12
TRANSPARENCY_CUTS = ((70, "high"), (45, "medium"), (20, "low"))
SENTENCE_CUTS = ((25, "accessible"), (45, "complex"))
MAX_NAMES = 30
MAX_EXAMPLES = 10
