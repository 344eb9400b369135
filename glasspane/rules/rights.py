"""Data-subject rights and the frameworks a policy refers to."""

# GDPR rights (id, label, article).
GDPR = (
    ("access", "Right of Access", "Art. 15 GDPR"),
    ("rectification", "Right to Rectification", "Art. 16 GDPR"),
    ("erasure", "Right to Erasure (Right to be Forgotten)", "Art. 17 GDPR"),
    ("restriction", "Right to Restriction of Processing", "Art. 18 GDPR"),
    ("portability", "Right to Data Portability", "Art. 20 GDPR"),
    ("objection", "Right to Object", "Art. 21 GDPR"),
    ("automated_decisions", "Rights re: Automated Decision-Making", "Art. 22 GDPR"),
    ("withdraw_consent", "Right to Withdraw Consent", "Art. 7(3) GDPR"),
    ("lodge_complaint", "Right to Lodge Complaint", "Art. 77 GDPR"),
)

# CCPA / CPRA rights (id, label, article).
CCPA = (
    ("right_to_know", "Right to Know", "CCPA §1798.100"),
    ("right_to_delete", "Right to Delete", "CCPA §1798.105"),
    ("right_to_opt_out", "Right to Opt-Out of Sale/Sharing", "CCPA §1798.120 / CPRA §1798.135"),
    ("right_to_non_discrimination", "Right to Non-Discrimination", "CCPA §1798.125"),
    ("right_to_correct", "Right to Correct (CPRA)", "CPRA §1798.106"),
    ("right_to_limit_sensitive", "Right to Limit Sensitive PI Use (CPRA)", "CPRA §1798.121"),
)

# Patterns per right, tried in this order over lower-cased text.
PATTERNS = {
    "access": (
        r"right\s+(?:of|to)\s+(?:access|know|be\s+informed\s+about)",
        r"access\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"request\s+a\s+copy\s+of\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"right\s+to\s+know\s+what\s+(?:personal\s+)?(?:data|information)",
        r"subject\s+access\s+request",
        r"data\s+access\s+request",
    ),
    "rectification": (
        r"right\s+(?:of|to)\s+rectification",
        r"rectif(?:y|ication)\s+(?:your|inaccurate)\s+(?:personal\s+)?(?:data|information)",
        r"correct\s+(?:inaccurate|incorrect|wrong)\s+(?:personal\s+)?(?:data|information)",
        r"update\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"right\s+to\s+correct",
        r"amend\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
    ),
    "erasure": (
        r"right\s+(?:of|to)\s+erasure",
        r"right\s+to\s+(?:be\s+forgotten|deletion|delete)",
        r"request\s+(?:the\s+)?deletion\s+of\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"erase\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"request\s+(?:that\s+)?(?:we|us)\s+delete",
        r"delete\s+(?:your|the)\s+(?:personal\s+)?(?:data|account|information)",
    ),
    "restriction": (
        r"right\s+(?:of|to)\s+restriction",
        r"restrict\s+(?:the\s+)?processing\s+of\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"right\s+to\s+limit\s+(?:the\s+)?(?:use|processing)",
        r"object\s+to\s+(?:the\s+)?processing",
    ),
    "portability": (
        r"right\s+(?:of|to)\s+(?:data\s+)?portability",
        r"portable\s+(?:copy|format)\s+of\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"machine.readable\s+format",
        r"receive\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)\s+in\s+a\s+"
        r"(?:structured|common|machine.readable)",
        r"transfer\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)\s+to\s+another",
        r"export\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
    ),
    "objection": (
        r"right\s+(?:of|to)\s+object",
        r"object\s+to\s+(?:the\s+)?(?:processing|use)\s+of\s+(?:your|the)\s+(?:personal\s+)?(?:data|information)",
        r"opt.out\s+of\s+(?:direct\s+)?(?:marketing|advertising)",
        r"unsubscribe\s+from\s+(?:marketing|promotional)",
        r"object\s+to\s+direct\s+marketing",
    ),
    "automated_decisions": (
        r"automated\s+(?:decision.?making|decisions?)",
        r"right\s+(?:not\s+to\s+be\s+subject|regarding)\s+automated",
        r"profiling\s+(?:that|which)\s+(?:has|produces|results\s+in)\s+(?:a\s+)?(?:legal|significant)",
        r"human\s+(?:review|oversight|involvement)\s+(?:of|in)\s+automated",
        r"contest\s+automated\s+decisions?",
    ),
    "withdraw_consent": (
        r"withdraw\s+(?:your\s+)?consent",
        r"revoke\s+(?:your\s+)?consent",
        r"opt.out\s+(?:at\s+any\s+time|whenever|from)",
        r"change\s+(?:your\s+)?(?:consent|mind)\s+at\s+any\s+time",
        r"without\s+affecting\s+the\s+lawfulness",
    ),
    "lodge_complaint": (
        r"supervisory\s+authority",
        r"data\s+protection\s+authority",
        r"lodge\s+a\s+complaint",
        r"file\s+a\s+complaint",
        r"information\s+commissioner",
        r"\bico\b",
        r"\bcnil\b",
        r"\bgarante\b",
        r"\bbfdi\b",
        r"data\s+protection\s+regulator",
    ),
    "right_to_know": (
        r"right\s+to\s+know",
        r"request\s+information\s+about\s+(?:the\s+)?(?:personal\s+)?(?:data|information)\s+(?:we\s+)?collect",
        r"disclose\s+(?:the\s+)?(?:categories|types)\s+of\s+personal\s+information",
        r"right\s+to\s+request\s+disclosure",
    ),
    "right_to_delete": (
        r"right\s+to\s+delete",
        r"right\s+to\s+(?:request\s+)?deletion",
        r"california\s+(?:consumer|resident)[^.]*delete",
        r"delete\s+(?:your\s+)?personal\s+information\s+(?:upon\s+)?request",
    ),
    "right_to_opt_out": (
        r"do\s+not\s+sell\s+(?:my\s+)?personal\s+information",
        r"opt.out\s+of\s+(?:the\s+)?(?:sale|selling)",
        r"right\s+to\s+opt.out\s+of\s+(?:the\s+)?(?:sale|sharing)",
        r"do\s+not\s+(?:sell\s+or\s+)?share\s+(?:my\s+)?personal\s+information",
        r"opt.out\s+of\s+(?:targeted\s+advertising|cross.context)",
        r"\bccpa\b",
    ),
    "right_to_non_discrimination": (
        r"(?:not|no)\s+(?:discriminate|discrimination)",
        r"we\s+will\s+not\s+(?:deny|charge|penalize)\s+(?:you\s+)?for\s+exercising",
        r"non.discriminatory",
        r"right\s+not\s+to\s+be\s+discriminated\s+against",
    ),
    "right_to_correct": (
        r"right\s+to\s+correct",
        r"correct\s+inaccurate\s+(?:personal\s+)?information",
        r"update\s+(?:or\s+correct|and\s+correct)",
    ),
    "right_to_limit_sensitive": (
        r"limit\s+(?:the\s+)?(?:use|disclosure)\s+of\s+(?:your\s+)?sensitive",
        r"right\s+to\s+limit\s+(?:use|sharing)\s+of\s+sensitive",
        r"sensitive\s+personal\s+information[^.]*opt.out",
    ),
}

# Other frameworks (label, patterns).
FRAMEWORKS = (
    ("LGPD (Brazil)", (r"\blgpd\b", r"lei geral de prote[cç][aã]o de dados", r"brazilian\s+(?:data\s+)?law")),
    ("PIPEDA (Canada)", (r"\bpipeda\b", r"personal\s+information\s+protection\s+and\s+electronic\s+documents",
                         r"canadian\s+(?:privacy\s+)?law")),
    ("COPPA (Children's Privacy)", (r"\bcoppa\b", r"children'?s\s+online\s+privacy\s+protection",
                                    r"under\s+(?:the\s+age\s+of\s+)?13")),
    ("HIPAA (Health Data US)", (r"\bhipaa\b", r"health\s+insurance\s+portability",
                                r"protected\s+health\s+information", r"\bphi\b")),
    ("PECR / ePrivacy (UK/EU)", (r"\bpecr\b", r"eprivacy\s+(?:regulation|directive)",
                                 r"privacy\s+and\s+electronic\s+communications")),
)

# Cookie topics.
COOKIE_TOPICS = {
    "consent_required": (
        r"(?:we\s+)?(?:obtain|ask|request|require)\s+(?:your\s+)?consent\s+(?:before|for|prior\s+to)\s+"
        r"(?:using|setting|placing)",
        r"cookie\s+consent", r"cookie\s+banner", r"consent\s+management"),
    "cookie_categories": (
        r"(?:necessary|essential|strictly\s+necessary)\s+(?:and\s+)?(?:functional|analytics|advertising)\s+cookies?",
        r"categories?\s+of\s+cookies?", r"analytical\s+cookies?", r"advertising\s+cookies?",
        r"performance\s+cookies?"),
    "httponly_secure": (
        r"(?:httponly|http\s+only)\s+(?:flag|attribute|cookie)", r"secure\s+(?:flag|attribute|cookie)", r"samesite",
        r"(?:cookie\s+)?security\s+(?:flag|attribute|settings?)"),
    "dnt_honored": (
        r"(?:do\s+not\s+track|dnt)", r"honor\s+(?:do\s+not\s+track|dnt)", r"respond\s+to\s+(?:do\s+not\s+track|dnt)",
        r"global\s+privacy\s+control", r"\bgpc\b"),
}

# Browser signals.
DNT_MENTIONED = r"do\s+not\s+track|\bdnt\b"
DNT_HONOURED = r"honor\w*\s+(?:do\s+not\s+track|dnt)"
GPC = r"global\s+privacy\s+control|\bgpc\b"
WINDOW = (50, 80)
GRADE_CUTS = ((90, "A"), (75, "B"), (55, "C"), (35, "D"))
