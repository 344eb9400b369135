"""Where a site keeps its policy."""

# Usual paths, English then Turkish.
POLICY_PATHS = (
    "/privacy", "/privacy-policy", "/privacy_policy", "/privacypolicy", "/legal/privacy", "/legal/privacy-policy",
    "/legal", "/policies/privacy", "/policies", "/data-privacy", "/data-protection", "/gdpr", "/en/privacy",
    "/en/privacy-policy", "/about/privacy", "/about/legal", "/help/privacy", "/support/privacy", "/info/privacy",
    "/terms/privacy",
    "/gizlilik", "/gizlilik-politikasi", "/gizlilik_politikasi", "/gizlilik-bildirimi", "/gizlilik-beyani", "/kvkk",
    "/kvkk-aydinlatma-metni", "/aydinlatma-metni", "/kisisel-verilerin-korunmasi", "/kisisel_verilerin_korunmasi",
    "/kisisel-veri-koruma", "/kisisel-veriler", "/veri-koruma", "/veri-gizliligi", "/cerez-politikasi", "/cerez",
    "/yasal/gizlilik", "/hukuki/gizlilik", "/yasal", "/tr/gizlilik", "/tr/kvkk", "/tr/privacy",
)

# Link texts (English, Turkish, German, French, Spanish), over lower-cased text.
LINK_TEXTS = (
    r"privacy\s*policy", r"privacy\s*notice", r"privacy\s*statement", r"data\s*protection", r"data\s*privacy",
    r"personal\s*data", r"cookie\s*policy",
    r"gizlilik\s*politikas[iı]", r"gizlilik\s*bildirim[i]", r"gizlilik\s*beyan[iı]", r"gizlilik", r"kvkk",
    r"ayd[iı]nlatma\s*metn[i]", r"ki[sş]isel\s*ver[i]", r"kişisel\s*ver[i]", r"veri\s*koruma",
    r"veri\s*gizlili[gğ][i]", r"[cç]erez\s*politikas[iı]", r"[cç]erez\s*(?:gizlilik|bildirimi)",
    r"veri\s*i[sş]leme",
    r"datenschutz", r"datenschutzerkl[äa]rung",
    r"politique\s*de\s*confidentialit[eé]", r"données\s*personnelles",
    r"pol[ií]tica\s*de\s*privacidad", r"privacidad",
)

# Parts of an address that mark a policy page.
URL_SIGNALS = (
    "/privacy", "privacy-policy", "privacy_policy", "privacypolicy", "data-protection", "data_protection", "/gdpr",
    "legal/privacy", "policies/privacy",
    "gizlilik", "kvkk", "aydinlatma", "kisisel-veri", "kisisel_veri", "verilerin-korunma", "verilerin_korunma",
    "veri-koruma", "veri_koruma", "cerez-politikasi", "cerez_politikasi", "veri-gizliligi",
    "datenschutz", "confidentialit", "privacidad",
)

# Words of which a policy contains at least three, in at least 200 characters.
POLICY_WORDS = (
    "personal information", "personal data", "privacy", "we collect", "data protection", "cookies", "third part",
    "retention", "consent", "data controller", "data processor",
    "gizlilik", "kişisel veri", "kisisel veri", "kvkk", "aydınlatma", "aydinlatma", "veri sorumlusu", "açık rıza",
    "acik riza", "veri işleme", "veri isleme", "çerez", "cerez", "veri koruma",
    "datenschutz", "personenbezogene", "données personnelles", "confidentialité", "datos personales", "privacidad",
)
MIN_POLICY_CHARS = 200
MIN_POLICY_WORDS = 3
READABLE_CHARS = 100

# Regions of a page whose links come first, in this order (kind of selector, value).
LINK_REGIONS = (
    ("tag", "footer"), ("role", "contentinfo"), ("class", "footer"), ("id", "footer"), ("class", "legal"),
    ("class", "legal-links"), ("tag", "nav"), ("role", "navigation"), ("class", "nav"), ("id", "nav"),
    ("class", "navbar"), ("class", "bottom-links"), ("class", "site-footer"),
)
SKIPPED_HREFS = ("#", "javascript:", "mailto:", "tel:")

# Sitemap names and limits.
SITEMAP_NAMES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
MAX_ROBOTS_SITEMAPS = 5
MAX_NESTED_SITEMAPS = 5

# Text extraction. Tags dropped, and id / class words of the main part.
DROPPED_TAGS = ("script", "style", "nav", "header", "noscript", "svg", "button")
MAIN_ID_WORDS = ("content", "main", "privacy", "policy", "gizlilik", "kvkk", "aydinlatma", "datenschutz")
MAIN_CLASS_WORDS = ("content", "main", "privacy", "policy", "article", "gizlilik", "kvkk", "aydinlatma",
                    "datenschutz")
MIN_LINE = 2
MIN_PAGE_LINE = 5
