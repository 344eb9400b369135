"""Policy wording and page markup that the shared test tables lack.

The test documents are invented prose without a single policy term, and the test pages carry no trackers. Each row of
the tables therefore gets a clause (chosen by its id) behind its own whole text, so that every rule fires somewhere and
stays silent elsewhere, while the real rows still set the volume. Production tables need none of this.
"""

from __future__ import annotations

CLAUSES = (
    "You have the right to access your personal data and the right to erasure. You may ask us to delete your account.",
    "You may lodge a complaint with the supervisory authority or write to the data protection officer at "
    "dpo@shop.example. Our legal basis is consent. We support privacy by design and use encryption.",
    "We keep for 6 months and for up to three years. We retain for up to 2 years certain records, for 30 days others.",
    "Records are kept as long as necessary and upon account deletion. We delete your data upon your request. "
    "Some are stored indefinitely, see storage limitation.",
    "By using our service you agree to this policy. Boxes are pre-selected. By accessing it you consent to cookies.",
    "Do not sell my personal information. Under CCPA you have the right to know and the right to delete. We honor do "
    "not track and the Global Privacy Control.",
    "We share your data with Google, Criteo and Stripe Inc. for targeted ads. Google Analytics gives us measurement. "
    "We share it with Meta too. Google LLC may host it.",
    "We rely on standard contractual clauses for international transfer. An adequacy decision may apply.",
    "We collect medical history and biometric data. We share your personal data with partners. Your name, your email "
    "address and your city are stored.",
    "The weather was calm and the garden was green.",
    "",
    "We never transfer your data to the United Kingdom. Cross-border data transfer is rare. Vendors and affiliates and "
    "each service provider, contractor or sub-processor follow our rules. Business partners and vendors too.",
    "Nightly logs are kept for 1.5 months. We store for ninety days your ip address, device id and browser type. We "
    "keep 400 days of billing and preserve 7 years of payment data.",
    "Explicit consent is asked with granular choice and you can withdraw your consent. It is opt-in.",
    "You can opt-out at any time, withdraw your consent and object to direct marketing. Informed consent matters. To "
    "opt-out you must send a written request to our address. Children under 13 need parental consent.",
    "Your information may be shared, data is collected and data could be disclosed. We use it for legal purposes, for "
    "example in some cases where applicable. We do not share it. We process, we use and we collect.",
    "The river ran south past the old mill.",
    "",
    "If you continue, this will constitute consent. Unless you notify us it will be deemed your consent. We may remind "
    "you again. Relevant advertising is shown. Please click agree to continue.",
    "Automated decision-making and profiling take place. Precise location and gps data, social security number, credit "
    "card and trade union membership are collected. Racial or ethnic origin and genetic data too.",
    "LGPD and PIPEDA apply, as does HIPAA. The ePrivacy Directive rules our cookie banner and advertising cookies. "
    "Each cookie has the secure flag and samesite. Rectification is possible: right to rectification, right to data "
    "portability, right to restriction, right to object.",
    "Acme Widgets GmbH and Blue River Ltd send newsletters. Facebook, TikTok, Hotjar, Mixpanel, LinkedIn and Amazon "
    "get usage data for advertising. Salesforce, HubSpot and Mailchimp run email marketing. Zendesk is our help desk.",
    "",
    "Stones lay along the quiet road.",
)

EXTRAS = (
    "",
    "In order to provide the service we verify your identity and comply with legal obligations. Data minimization "
    "guides us. We will not discriminate.",
    "Political opinions, religion, sexual orientation: none. Your preferences, your profile and browsing history help "
    "various similar purposes, such as product development and business purposes.",
    "",
    "Third parties may receive your personal information. We disclose to partners. We sell some data. Photos, videos "
    "and comments you post stay yours. Private messages are not read.",
    "",
    "The supervisory authority is the ICO. You have the right to correct. Limit the use of your sensitive data.",
)

# One fragment per page, behind the page's own markup.
FRAGMENTS = (
    '<script src="https://www.google-analytics.com/analytics.js"></script><script>var c=document.x;canvas.toDataURL();'
    '</script><footer class="site-footer"><a href="/legal/privacy-policy">Privacy Policy</a></footer>',
    '<img src="https://beacon.unknown-host.test/p.gif" width="1" height="1"><img src="https://pixel.quantserve.com/x">'
    '<iframe src="https://stats.g.doubleclick.net/i"></iframe><a href="https://partner.test/kvkk">Bilgi</a>',
    '<script src="/js/app.js"></script><script src="//cdn.jsdelivr.net/npm/x.js"></script><button>Accept all</button>'
    '<input type="checkbox" name="consent_ads" checked>',
    '<script>navigator.plugins;hj.q=1;</script><script src="https://static.hotjar.com/c/h.js"></script>'
    '<script>load("mixpanel.com");load("hotjar.com")</script><a href="#top">up</a>',
    '<div id="onetrust-banner" class="consent-banner" aria-label="cookie choice"><button>I agree</button>'
    '<a href="/x">Decline</a></div><script src="https://cdn.cookielaw.org/onetrust.js"></script>',
    '<!-- <script src="https://criteo.com/hidden.js"></script> --><nav><a href="/datenschutz">Datenschutz</a></nav>',
    '',
    '<script src="https://connect.facebook.net/fbevents.js"></script><script src="https://fpjs.io/agent.js"></script>'
    '<script src="https://static.ads-twitter.com/u.js"></script><script src="https://bat.bing.com/b.js"></script>'
    '<script src="https://js.hs-scripts.com/1.js"></script><script src="https://sub.criteo.com/a.js"></script>'
    '<iframe src="https://www.linkedin.com/embed"></iframe><script src="https://www.linkedin.com/in.js"></script>'
    '<img src="https://ib.adnxs.com/track?id=1"><script src="https://www.google-analytics.com/ga.js"></script>',
    '<main><p>Privacy notice body</p><p>We collect personal data and cookies.</p>'
    '<p>Gr&uuml;&szlig;e &#252; &#xFC; &#0; &hellip;&NotEqualTilde; &nosuch; &amp;lt; A&B &copy &#128512;</p></main><footer><a href="mailto:a@b.c">'
    'Mail</a><a href="/gdpr">Your data</a><a href="/security">Security</a><a href="https://trust.test/compliance">Trust'
    '</a><a href="/dpa">DPA</a></footer>',
    '<noscript><p>This page needs scripts, but our privacy notice says that we collect personal data with consent and '
    'cookies, and that retention is short for every visitor of the site.</p></noscript>'
    '<script type="application/ld+json">{"name": "short", "body": "Personal information is collected with consent and '
    'kept as the privacy notice explains", "more": ["cookies are used for data protection in every case here", 5, null]}'
    '</script>',
    '<script>attribution-reporting("x");LR.identify("u");</script><img src="/own/pixel.png"><img width="1" height="0">',
    '<p>Cookie preferences by <b>usercentrics</b> and didomi.</p><a href="/about">About us</a>',
    '<div class="wide  legal"><div><div>Inner</div><a href="/terms">Terms</a></div><a href="../../privacy-choices/./?x=1">Choices</a></div>'
    '<div id="footer" title="a > b"><section><a href="/imprint">Imprint</a></section><a href="/a/../cookie-policy/..">Cookies</a></div>'
    '<span class="Footer"><a href="/other">Other</a></span><ul role="navigation"><li><a href="/last">Last</a>',
)

# Set-Cookie headers per page, separated by line ends.
COOKIES = (
    "sid=abc; Path=/; HttpOnly; Secure; SameSite; Max-Age=86400\n_ga=GA1.2.3; Max-Age=63072000; Domain=.shop.example",
    "",
    "x=1; Expires=Wed, 01 Jan 2031 00:00:00 GMT\nPHPSESSID=q8s7; HttpOnly; Path=/app",
    "_fbp=fb.1.2; Max-Age=7776000; Secure; SameSite=None\nfoo=; Max-Age=0\ntrk=averylongcookievalue0123456789; Domain="
    ".doubleclick.net; Max-Age=604800; Secure\nhx=1; Domain=hotjar.com; Max-Age=abc",
    "csrftoken=t; Secure; HttpOnly; SameSite=Strict; Max-Age=1209600",
)

# robots.txt and sitemap bodies per page; "@" stands for the base address of the page.
ROBOTS = (
    "User-agent: *\nSitemap: @/maps/one.xml\nsitemap: @/maps/two.xml",
    "User-agent: *\nDisallow: /private",
    "",
)
SITEMAPS = (
    "<urlset><url><loc> @/about </loc></url><url><loc>@/legal/privacy</loc></url><url><loc>@/gdpr</loc></url></urlset>",
    "<sitemapindex><sitemap><loc>@/maps/one.xml</loc></sitemap><sitemap><loc>@/maps/two.xml</loc></sitemap>"
    "</sitemapindex>",
    "<urlset><url><loc>@/contact</loc></url></urlset>",
    "",
)

# Stored answers of a language model, one per conversation turn by its number.
ANSWERS = (
    '```json\n{"tldr": "src sells data", "headline_risks": ["sale", "profiling"], "red_flags": [{"issue": "Sale", '
    '"severity": "low"}, {"issue": "Tracking", "severity": "critical"}], "positive_findings": []}\n```',
    '{"tldr": "all fine", "plain_summary": "short", "headline_risks": [], "recommended_actions": ["opt out"]}',
    "Sorry, I cannot answer that.",
    '```\n{"tldr": "cut off", "headline_risks": ["x"]',
)

# Domains of the companies whose sites some test pages are.
COMPANY_DOMAINS = ("acmewidgetsgmbh.com", "blueriverltd.com", "stripeinc.com")

# Stored answers about companies, by the number of the turn.
PARTY_ANSWERS = (
    '```json\n{"summary": "Sells profiles.", "gdpr_role": "Controller", "risk_flags": ["Device fingerprinting", "No end date"], "trust_score_ai": 25, '
    '"certifications": ["SOC 2"], "data_location": ["US", "EU"], "data_shared_with": ["Blue River Ltd"]}\n```',
    '{"summary": "Careful.", "gdpr_role": "Processor", "risk_flags": [], "trust_score_ai": 85, "retention_claimed": "30 days", "data_collected": ["email"], '
    '"positive_signals": ["Audited"]}',
    "Sorry, this company is not known to me.",
    "",
    '{"summary": "Little is said.", "risk_flags": ["Vague terms"]}',
)
