"""Manipulative consent wording."""

# Type, label, severity, legal reference.
TYPES = (
    ("confirm_shaming", "Confirmshaming", "high", "EDPB Guidelines 03/2022 §3.3"),
    ("hidden_opt_out", "Hidden / Difficult Opt-Out", "high", "GDPR Art. 7(3), EDPB Guidelines 03/2022 §3.1"),
    ("pre_ticked_boxes", "Pre-Ticked Consent Boxes", "high", "GDPR Art. 4(11), Recital 32, Planet49 (C-673/17)"),
    ("bundled_consent", "Bundled / Tied Consent", "high", "GDPR Art. 4(11), WP259 rev.01 §3.1"),
    ("misdirection", "Misdirection / Misleading Framing", "medium", "EDPB Guidelines 03/2022 §3.2"),
    ("nagging", "Repeated Consent Requests (Nagging)", "medium", "EDPB Guidelines 03/2022 §3.4"),
    ("obstruction", "Obstruction of Rights Exercise", "medium", "GDPR Art. 12(3), Art. 17"),
    ("obfuscation", "Obfuscated Purposes", "medium", "GDPR Art. 5(1)(b) – Purpose Limitation"),
    ("retroactive_consent", "Retroactive / Implicit Consent", "high",
     "GDPR Art. 4(11), Recital 32 – freely given, specific, informed"),
    ("false_urgency", "False Urgency / Forced Action", "low",
     "EDPB Guidelines 03/2022 §3.3 – Free choice requirement"),
)

# Patterns per type, tried in this order.
PATTERNS = {
    "confirm_shaming": (
        r"no\s*[,;]?\s*(?:thanks?|thank\s+you)[,;]?\s+i\s+(?:don'?t|do\s+not)\s+(?:want|care|need)",
        r"no\s*[,;]?\s*(?:i\s+)?(?:don'?t|do\s+not)\s+(?:care\s+about|value|want)\s+(?:my\s+)?(?:privacy|data)",
        r"i\s+(?:don'?t|do\s+not)\s+(?:care\s+about|want)\s+(?:my|better|improved)\s+"
        r"(?:privacy|experience|security)",
        r"i\s+prefer\s+not\s+to\s+(?:know|protect|care)",
        r"no\s*[,;]?\s*(?:i\s+)?prefer\s+(?:less\s+)?(?:privacy|security)",
    ),
    "hidden_opt_out": (
        r"(?:to\s+opt.out|unsubscribe|withdraw\s+consent)[^.]*"
        r"(?:contact\s+us|email\s+us|mail\s+us|call\s+us|write\s+to)",
        r"(?:to\s+opt.out)[^.]*(?:send\s+(?:a\s+)?(?:written\s+)?request)",
        r"(?:to\s+opt.out)[^.]*(?:post|mail)[^.]*(?:address|headquarters)",
        r"manage\s+(?:your\s+)?(?:preferences|settings)\s+(?:by\s+)?(?:contacting|emailing|writing)",
    ),
    "pre_ticked_boxes": (
        r"(?:pre.?selected|pre.?ticked|checked\s+by\s+default|ticked\s+by\s+default)",
        r"(?:boxes?\s+(?:are\s+)?(?:pre.?)?(?:checked|ticked|selected))",
        r"(?:default(?:ly|ed)?\s+(?:opted\s+in|selected|enabled|checked))",
        r"(?:automatically\s+(?:opted\s+in|selected|enrolled))",
        r"(?:unless\s+you\s+(?:opt.out|uncheck|deselect|untick))",
    ),
    "bundled_consent": (
        r"by\s+(?:using|accessing|registering|signing\s+up|creating\s+an\s+account)[^.]*"
        r"you\s+(?:agree|consent|authorize)",
        r"your\s+(?:continued\s+use|use\s+of\s+(?:our\s+)?(?:service|site|app))[^.]*"
        r"constitutes?\s+(?:your\s+)?(?:agreement|consent|acceptance)",
        r"by\s+clicking\s+['\"]?(?:i\s+agree|accept|ok|continue|sign\s+up)['\"]?[^.]*you\s+(?:agree|consent)",
    ),
    "misdirection": (
        r"(?:share|sell|transfer)\s+your\s+(?:data|information)\s+(?:to|with)\s+(?:our\s+)?(?:trusted\s+)?"
        r"partners?\s+(?:to|in\s+order\s+to)\s+(?:improve|enhance|personalize|provide)",
        r"we\s+(?:share|use)\s+your\s+(?:data|information)\s+to\s+(?:serve|show)\s+you\s+"
        r"(?:relevant|personalized|better|more\s+useful)\s+(?:ads?|advertisements?)",
        r"(?:relevant|personalized|tailored)\s+(?:advertising|ads?|marketing)",
    ),
    "nagging": (
        r"(?:may|will|could)\s+(?:continue\s+to\s+)?(?:ask|prompt|remind)\s+you\s+(?:again|periodically)",
        r"(?:re.?request|re.?ask)\s+(?:your\s+)?consent",
    ),
    "obstruction": (
        r"(?:delete|close|remove|deactivate)\s+(?:your\s+)?account[^.]*(?:contact\s+(?:us|support)|email|call|write)",
        r"(?:deletion|removal|erasure)\s+(?:request)?[^.]*(?:up\s+to|may\s+take|within)\s+\d+\s+(?:business\s+)?"
        r"(?:day|week|month)s?[^.]*(?:to\s+process|to\s+complete|to\s+fulfill)",
        r"(?:notarized|sworn\s+affidavit|government.issued\s+id)[^.]*(?:required|must\s+provide|submit)",
    ),
    "obfuscation": (
        r"(?:for\s+any\s+(?:other\s+)?(?:purpose|reason))\s+(?:we\s+(?:deem|consider|determine|think))",
        r"for\s+purposes?\s+(?:described|set\s+(?:out|forth|forth)\s+in)\s+(?:this|our)\s+"
        r"(?:policy|agreement|terms)",
        r"(?:any\s+other\s+)?purpose\s+for\s+which\s+you\s+(?:provide|give|submit)\s+(?:your\s+)?"
        r"(?:data|information|consent)",
        r"(?:as\s+(?:otherwise\s+)?(?:permitted|allowed|authorized)\s+by\s+(?:law|applicable\s+law))",
    ),
    "retroactive_consent": (
        r"if\s+you\s+(?:continue|do\s+not\s+(?:opt.out|object|contact\s+us))[^.]*"
        r"(?:will\s+be\s+deemed|(?:will\s+)?constitute|(?:will\s+)?mean)\s+(?:you\s+)?(?:have\s+)?"
        r"(?:agree|consent|accept)",
        r"your\s+failure\s+to\s+(?:opt.out|object|contact)[^.]*(?:constitutes?|means?|implies?)\s+(?:your\s+)?"
        r"(?:agreement|consent|acceptance)",
        r"unless\s+you\s+(?:notify|contact|email|tell)\s+us[^.]*(?:will\s+be\s+deemed|(?:will\s+)?constitute)\s+"
        r"(?:your\s+)?consent",
    ),
    "false_urgency": (
        r"(?:must|required to)\s+(?:accept|agree|consent)\s+(?:to\s+)?(?:continue|proceed|access)",
        r"(?:click|press)\s+['\"]?(?:agree|accept|ok)['\"]?\s+to\s+continue",
        r"by\s+(?:continuing|proceeding)[^.]*you\s+(?:agree|accept|consent)",
    ),
}

# Signs of a proper consent mechanism.
EXPLICIT = r"(?:explicit|freely\s+given|informed)\s+consent|opt.in|affirmative\s+(?:action|consent)"
GRANULAR = r"(?:granular|individual|separate)\s+(?:choice|consent|opt.in)"
WITHDRAWAL = r"withdraw\s+(?:your\s+)?consent|revoke\s+consent|opt.out\s+at\s+any\s+time"
WINDOW = (60, 60)
MAX_SNIPPETS = 2
