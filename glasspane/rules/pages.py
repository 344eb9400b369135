"""Signals in page markup, scripts and cookies."""

# Script fragments that fingerprint a browser (case matters).
FINGERPRINTING = (
    r"canvas\.toDataURL", r"getImageData", r"HTMLCanvasElement", r"AudioContext\(\)", r"webkitAudioContext",
    r"createOscillator", r"createAnalyser", r"WebGLRenderingContext",
    r"getParameter\s*\(\s*(?:RENDERER|VENDOR|VERSION)", r"getSupportedExtensions", r"document\.fonts\.check",
    r"measureText\b", r"navigator\.plugins\b", r"navigator\.mimeTypes\b", r"navigator\.hardwareConcurrency",
    r"navigator\.deviceMemory", r"navigator\.getBattery", r"screen\.colorDepth", r"screen\.pixelDepth",
    r"navigator\.connection\.", r"FingerprintJS", r"Fingerprint2", r"fingerprintjs", r"getFingerprint\b",
    r"visitorId",
)

# Script fragments that record a session (case matters).
RECORDING = (r"hj\.q\b", r"_hj\b", r"FS\.identify", r"window\['_fs_", r"LR\.identify", r"window\.LogRocket",
             r"clarity\(", r"smartlook\.", r"mouseflow\.")

# Consent platforms by their traces, first match wins.
CONSENT_PLATFORMS = (
    ("OneTrust", (r"onetrust", r"optanon", r"cookielawscript")),
    ("Cookiebot", (r"cookiebot", r"consent\.cookiebot")),
    ("TrustArc", (r"trustarc", r"truste\.com")),
    ("Osano", (r"osano\.com",)),
    ("Consentmanager", (r"consentmanager\.net",)),
    ("Quantcast Choice", (r"quantcast\.com.*consent",)),
    ("GDPR Cookie Notice", (r"gdpr-cookie-notice",)),
    ("Cookie Information", (r"cookieinformation\.com",)),
    ("Usercentrics", (r"usercentrics",)),
    ("Didomi", (r"sdk\.privacy-center\.org", r"didomi")),
    ("Termly", (r"termly\.io",)),
    ("Iubenda", (r"iubenda\.com",)),
)
PRIVACY_SANDBOX = r"attribution-reporting|fledge|topics-api|privacy.sandbox|pa\.js"

# Consent banners by attribute (exact id, exact class word, part of id / class / aria-label), and
# consent platforms by part of a script address, first match wins.
BANNER_IDS = ("cookiebanner", "cookie-banner", "cookie-consent", "gdpr-banner")
BANNER_CLASSES = ("cookie-consent", "gdpr-banner", "consent-banner")
BANNER_ID_PARTS = ("onetrust", "cookielaw", "cookiebot")
BANNER_CLASS_PARTS = ("cookieconsent", "cookie-notice")
BANNER_ARIA_PARTS = ("cookie", "consent")
SCRIPT_PLATFORMS = (("onetrust", "OneTrust"), ("cookiebot", "Cookiebot"), ("trustarc", "TrustArc"),
                    ("osano", "Osano"), ("usercentrics", "Usercentrics"), ("didomi", "Didomi"),
                    ("iubenda", "Iubenda"))

# Button texts, and the two findings.
ACCEPT_TEXT = r"accept\s*all|i\s*agree|allow\s*all|ok|got\s*it"
REJECT_TEXT = r"reject|decline|no\s*thanks|only\s*necessary|manage\s*preferences"
NO_REJECT = "No visible reject/decline option found"
PRE_TICKED = "Pre-ticked consent checkbox detected"

# Cookie name prefixes and cookie domains by category; earlier rows win.
COOKIE_PREFIXES = (
    ("necessary", ("sessionid", "session", "csrftoken", "csrf", "phpsessid", "jsessionid", "asp.net_sessionid",
                   "auth", "token", "__host-", "secure-")),
    ("analytics", ("_ga", "_gid", "_gat", "mp_", "__hssc", "__hssrc", "__hstc", "_hjid", "_hjsessionuser",
                   "amplitude", "ajs_")),
    ("advertising", ("_fbp", "_fbc", "fr", "__gads", "__gac", "nid", "sid", "1p_jar", "ide", "dsid", "dsp_uid",
                     "uid", "criteo", "adrl")),
)
COOKIE_DOMAINS = (
    ("analytics", ("google-analytics", "hotjar", "mixpanel", "amplitude")),
    ("advertising", ("doubleclick", "facebook", "criteo", "adroll")),
)

# Duration bands in seconds, and preview length.
DURATIONS = ((0, "deleted"), (86400, "≤1 day"), (604800, "≤1 week"), (2592000, "≤30 days"), (31536000, "≤1 year"))
YEAR_SECONDS = 31536000
VALUE_PREVIEW = 20
MAX_COOKIES = 50

# Badge colours by number of trackers above.
BADGE_CUTS = ((15, "red"), (5, "orange"))
