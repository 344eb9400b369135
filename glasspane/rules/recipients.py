"""Who receives data, what for, and across which borders."""

# Unnamed kinds of recipient.
UNNAMED = (
    r"third.?part(?:y|ies)", r"service\s+provider", r"business\s+partner", r"affiliate", r"vendor", r"contractor",
    r"sub.?processor", r"data\s+processor", r"advertising\s+partner", r"analytics\s+partner",
    r"marketing\s+partner", r"cloud\s+(?:service\s+)?provider", r"payment\s+processor",
    r"shipping\s+(?:partner|provider)", r"customer\s+support\s+(?:partner|provider|tool)", r"research\s+partner",
    r"joint\s+controller",
)

# Brand names looked for as whole words (case matters).
BRANDS = (
    "Google", "Facebook", "Meta", "Twitter", "X", "LinkedIn", "Microsoft", "Apple", "Amazon", "Stripe", "PayPal",
    "Shopify", "Salesforce", "HubSpot", "Mailchimp", "Klaviyo", "Twilio", "SendGrid", "Zendesk", "Intercom",
    "Drift", "Crisp", "Hotjar", "FullStory", "LogRocket", "Mixpanel", "Amplitude", "Segment", "Heap",
    "Optimizely", "Braintree", "Adyen", "Square", "Cloudflare", "Fastly", "Akamai",
    "TikTok", "Snapchat", "Pinterest", "Reddit", "YouTube", "Instagram", "WhatsApp",
    "Marketo", "Pardot", "Eloqua", r"Constant\s+Contact", r"Campaign\s+Monitor",
    "Criteo", "DoubleClick", "AdRoll", "AppNexus", "Xandr", "TradeDesk",
    "Taboola", "Outbrain", "ShareThrough", "OpenX", "Rubicon", "PubMatic",
    "Nielsen", "Comscore", "comScore", "QuantCast",
    "NewRelic", "Datadog", "Sentry", "Dynatrace", "Splunk",
    "DocuSign", "HelloSign", "Adobe", "Acrobat",
    "Zuora", "Chargebee", "Recurly",
    "FedEx", "UPS", "DHL", "USPS",
    "Trustpilot", "Bazaarvoice", "Yotpo",
)

# Purposes of sharing.
PURPOSES = {
    "analytics": (r"analytics?", r"measurement", r"audience\s+measurement", r"traffic\s+analysis",
                  r"performance\s+tracking", r"user\s+behavior"),
    "advertising": (r"advertis(?:ing|ement)", r"targeted\s+ads?", r"ad\s+(?:serving|delivery|network)",
                    r"behavioral\s+advertising", r"interest.based\s+advertising", r"retargeting", r"remarketing"),
    "payment": (r"payment\s+processing", r"transaction\s+processing", r"billing",
                r"fraud\s+(?:detection|prevention)", r"credit\s+card\s+processing"),
    "customer_support": (r"customer\s+support", r"help\s+desk", r"live\s+chat", r"support\s+ticketing"),
    "email_marketing": (r"email\s+marketing", r"newsletters?", r"email\s+campaigns?", r"marketing\s+emails?",
                        r"promotional\s+emails?"),
    "social_media": (r"social\s+(?:media\s+)?(?:sharing|plugin|widget|button)", r"social\s+login",
                     r"social\s+network"),
    "hosting": (r"cloud\s+(?:hosting|storage|infrastructure)", r"server", r"hosting\s+provider",
                r"content\s+delivery\s+network", r"\bcdn\b"),
    "legal_compliance": (r"law\s+enforcement", r"legal\s+(?:obligation|requirement|process)", r"court\s+order",
                         r"government\s+(?:request|authority)", r"regulatory\s+(?:requirement|authority)"),
}

# Sale of data (negation is not looked at), transfers abroad, and safeguards by name.
SALE = r"\b(?:sell|sale|sold)\b.{0,50}(?:personal\s+)?(?:information|data)"
TRANSFERS = (
    r"transfer\w*\s+(?:personal\s+)?(?:data|information)\s+(?:to|outside of|outside)\s+(?:the\s+)?"
    r"(?:european|eu|eea|united\s+kingdom|uk)",
    r"cross.border\s+(?:data\s+)?transfer",
    r"international\s+(?:data\s+)?transfer",
    r"standard\s+contractual\s+clauses?",
    r"\bscc\b",
)
SAFEGUARDS = (
    ("Standard Contractual Clauses (SCCs)", r"standard\s+contractual\s+clauses?|\bsccs?\b"),
    ("Adequacy Decision", r"adequacy\s+decision"),
    ("Binding Corporate Rules (BCRs)", r"binding\s+corporate\s+rules?|\bbcrs?\b"),
    ("EU-U.S. Data Privacy Framework", r"eu.u\.s\.\s+data\s+privacy\s+framework"),
)

# Trust labels and defaults.
TRUST_CUTS = ((70, "trusted"), (50, "moderate"), (30, "concerning"))
DEFAULT_TRUST = 50
DEFAULT_CATEGORY = "Unknown"
MENTION_WINDOW = (60, 80)
PURPOSE_RADIUS = 200
MAX_PARTIES = 30
