"""Known tracker hosts."""

# Host, name, category, risk, fingerprinting, session recording, opt-out address.
TRACKERS = (
    ("google-analytics.com", "Google Analytics", "Analytics", "medium", False, False, "https://tools.google.com/dlpage/gaoptout"),
    ("googletagmanager.com", "Google Tag Manager", "Tag Manager", "medium", False, False, None),
    ("analytics.google.com", "Google Analytics (GA4)", "Analytics", "medium", False, False, "https://tools.google.com/dlpage/gaoptout"),
    ("doubleclick.net", "Google DoubleClick", "Advertising", "high", True, False, "https://adssettings.google.com/"),
    ("googlesyndication.com", "Google AdSense", "Advertising", "high", False, False, "https://adssettings.google.com/"),
    ("googleadservices.com", "Google Ads", "Advertising", "high", False, False, "https://adssettings.google.com/"),
    ("connect.facebook.net", "Facebook Pixel", "Advertising", "high", True, False, "https://www.facebook.com/ads/preferences/"),
    ("facebook.net", "Facebook SDK", "Social / Advertising", "high", True, False, "https://www.facebook.com/ads/preferences/"),
    ("graph.facebook.com", "Facebook Graph API", "Social", "medium", False, False, None),
    ("hotjar.com", "Hotjar", "Session Recording / Analytics", "high", False, True, "https://www.hotjar.com/legal/compliance/opt-out"),
    ("static.hotjar.com", "Hotjar", "Session Recording / Analytics", "high", False, True, "https://www.hotjar.com/legal/compliance/opt-out"),
    ("mixpanel.com", "Mixpanel", "Analytics", "medium", False, False, "https://mixpanel.com/optout"),
    ("cdn.mxpnl.com", "Mixpanel CDN", "Analytics", "medium", False, False, "https://mixpanel.com/optout"),
    ("segment.com", "Segment", "Customer Data Platform", "medium", False, False, None),
    ("segment.io", "Segment", "Customer Data Platform", "medium", False, False, None),
    ("amplitude.com", "Amplitude", "Analytics", "medium", False, False, "https://amplitude.com/privacy"),
    ("cdn.amplitude.com", "Amplitude CDN", "Analytics", "medium", False, False, None),
    ("fullstory.com", "FullStory", "Session Recording", "high", True, True, "https://www.fullstory.com/optout"),
    ("rs6.net", "Constant Contact", "Email Marketing", "medium", False, False, None),
    ("logrocket.com", "LogRocket", "Session Recording", "high", False, True, None),
    ("clarity.ms", "Microsoft Clarity", "Analytics / Session Recording", "high", False, True, None),
    ("heap.io", "Heap Analytics", "Analytics", "medium", False, False, None),
    ("heapanalytics.com", "Heap Analytics", "Analytics", "medium", False, False, None),
    ("mouseflow.com", "Mouseflow", "Session Recording", "high", False, True, "https://mouseflow.com/opt-out"),
    ("smartlook.com", "Smartlook", "Session Recording", "high", False, True, None),
    ("criteo.com", "Criteo", "Advertising", "high", True, False, "https://www.criteo.com/privacy/disable-criteo-services-on-internet/"),
    ("adroll.com", "AdRoll", "Advertising", "high", True, False, "https://app.adroll.com/optout/safari"),
    ("ads.twitter.com", "Twitter Ads", "Advertising", "high", False, False, "https://twitter.com/settings/personalization"),
    ("static.ads-twitter.com", "Twitter Ads", "Advertising", "high", False, False, "https://twitter.com/settings/personalization"),
    ("platform.twitter.com", "Twitter Widgets", "Social", "medium", False, False, None),
    ("www.linkedin.com", "LinkedIn Insight Tag", "Advertising / Analytics", "high", False, False, "https://www.linkedin.com/psettings/guest-controls/retargeting-opt-out"),
    ("snap.licdn.com", "LinkedIn CDN", "Advertising", "high", False, False, None),
    ("sc-static.net", "Snap Pixel", "Advertising", "high", False, False, None),
    ("tr.snapchat.com", "Snap Pixel", "Advertising", "high", False, False, None),
    ("static.klaviyo.com", "Klaviyo", "Email Marketing", "medium", False, False, None),
    ("a.klaviyo.com", "Klaviyo", "Email Marketing", "medium", False, False, None),
    ("js.hs-scripts.com", "HubSpot", "Marketing Automation", "medium", False, False, None),
    ("js.hsforms.net", "HubSpot Forms", "Marketing Automation", "medium", False, False, None),
    ("munchkin.marketo.net", "Marketo Munchkin", "Marketing Automation", "medium", False, False, None),
    ("bat.bing.com", "Microsoft Bing Ads", "Advertising", "medium", False, False, "https://account.microsoft.com/privacy/"),
    ("ads.pinterest.com", "Pinterest Tag", "Advertising", "medium", False, False, None),
    ("log.pinterest.com", "Pinterest Analytics", "Analytics", "medium", False, False, None),
    ("tiktok.com", "TikTok Pixel", "Advertising", "high", False, False, None),
    ("analytics.tiktok.com", "TikTok Analytics", "Advertising", "high", False, False, None),
    ("cdn.optimizely.com", "Optimizely", "A/B Testing", "low", False, False, "https://www.optimizely.com/legal/opt-out/"),
    ("d37gvrvc0wt4s1.cloudfront.net", "Optimizely CDN", "A/B Testing", "low", False, False, None),
    ("app.vwo.com", "VWO (Visual Website Optimizer)", "A/B Testing", "low", False, True, None),
    ("intercom.io", "Intercom", "Customer Support", "medium", False, False, None),
    ("widget.intercom.io", "Intercom Widget", "Customer Support", "medium", False, False, None),
    ("static.zdassets.com", "Zendesk", "Customer Support", "low", False, False, None),
    ("js.driftt.com", "Drift", "Customer Support / Marketing", "medium", False, False, None),
    ("cdn.jsdelivr.net", "jsDelivr CDN", "CDN", "low", False, False, None),
    ("cdnjs.cloudflare.com", "Cloudflare CDN", "CDN", "low", False, False, None),
    ("unpkg.com", "unpkg CDN", "CDN", "low", False, False, None),
    ("fonts.googleapis.com", "Google Fonts", "CDN / Fonts", "low", False, False, None),
    ("fonts.gstatic.com", "Google Fonts Static", "CDN / Fonts", "low", False, False, None),
    ("ajax.googleapis.com", "Google APIs", "CDN", "low", False, False, None),
    ("fingerprintjs.com", "FingerprintJS", "Fingerprinting", "critical", True, False, None),
    ("fpjs.io", "FingerprintJS Pro", "Fingerprinting", "critical", True, False, None),
    ("sentry.io", "Sentry", "Error Monitoring", "low", False, False, None),
    ("browser.sentry-cdn.com", "Sentry CDN", "Error Monitoring", "low", False, False, None),
    ("cdn.segment.com", "Segment CDN", "Customer Data Platform", "medium", False, False, None),
    ("cdn.cookielaw.org", "OneTrust / CookieLaw", "Consent Management", "low", False, False, None),
    ("optanon.blob.core.windows.net", "OneTrust", "Consent Management", "low", False, False, None),
    ("consent.cookiebot.com", "Cookiebot", "Consent Management", "low", False, False, None),
    ("tagmanager.google.com", "Google Tag Manager Preview", "Tag Manager", "medium", False, False, None),
    ("pagead2.googlesyndication.com", "Google Display Ads", "Advertising", "high", False, False, "https://adssettings.google.com/"),
    ("adservice.google.com", "Google Ad Service", "Advertising", "high", False, False, None),
    ("scorecardresearch.com", "Comscore / Scorecard Research", "Analytics", "medium", False, False, "http://www.scorecardresearch.com/optout.aspx"),
    ("b.scorecardresearch.com", "Comscore Beacon", "Analytics", "medium", False, False, None),
    ("quantserve.com", "Quantcast", "Analytics / Advertising", "high", True, False, "https://www.quantcast.com/opt-out/"),
    ("pixel.quantserve.com", "Quantcast Pixel", "Analytics / Advertising", "high", False, False, None),
    ("adnxs.com", "AppNexus / Xandr", "Advertising", "high", True, False, "https://www.xandr.com/privacy/platform-privacy-policy/"),
    ("ib.adnxs.com", "AppNexus / Xandr", "Advertising", "high", False, False, None),
    ("pubmatic.com", "PubMatic", "Advertising", "high", True, False, "https://pubmatic.com/legal/privacy-policy/#optout"),
    ("ads.pubmatic.com", "PubMatic Ads", "Advertising", "high", False, False, None),
    ("rubiconproject.com", "Magnite (Rubicon Project)", "Advertising", "high", True, False, "https://www.magnite.com/privacy-policy/#opt-out"),
    ("openx.net", "OpenX", "Advertising", "high", True, False, "https://www.openx.com/legal/privacy-policy/"),
    ("casalemedia.com", "Casale Media / Index Exchange", "Advertising", "high", False, False, None),
    ("taboola.com", "Taboola", "Advertising", "high", False, False, "https://www.taboola.com/privacy-policy#user-choices-and-opting-out"),
    ("outbrain.com", "Outbrain", "Advertising", "high", False, False, "https://my.outbrain.com/recommendations-settings/home"),
    ("cdn.freshdesk.com", "Freshdesk", "Customer Support", "low", False, False, None),
    ("wchat.io", "Freshchat", "Customer Support", "low", False, False, None),
    ("tawk.to", "Tawk.to", "Customer Support", "low", False, False, None),
)

# Risk per tracker category.
CATEGORY_RISK = (
    ("Analytics", "medium"), ("Advertising", "high"), ("Session Recording", "high"), ("Fingerprinting", "critical"),
    ("Social", "medium"), ("Tag Manager", "medium"), ("Customer Data Platform", "medium"),
    ("Marketing Automation", "medium"), ("Email Marketing", "medium"), ("A/B Testing", "low"),
    ("Customer Support", "low"), ("Consent Management", "low"), ("Error Monitoring", "low"), ("CDN", "low"),
    ("CDN / Fonts", "low"),
)

# Hosts watched live, and those of high risk among them.
LIVE_HOSTS = (
    "google-analytics.com", "googletagmanager.com", "analytics.google.com", "doubleclick.net",
    "googlesyndication.com", "googleadservices.com", "connect.facebook.net", "facebook.net", "hotjar.com",
    "static.hotjar.com", "mixpanel.com", "segment.com", "segment.io", "amplitude.com", "fullstory.com",
    "logrocket.com", "clarity.ms", "heap.io", "criteo.com", "adroll.com", "ads.twitter.com",
    "platform.twitter.com", "snap.licdn.com", "sc-static.net", "static.klaviyo.com", "js.hs-scripts.com",
    "munchkin.marketo.net", "bat.bing.com", "quantserve.com", "scorecardresearch.com", "adnxs.com",
    "pubmatic.com", "rubiconproject.com", "openx.net", "taboola.com", "outbrain.com", "fingerprintjs.com",
    "fpjs.io", "tiktok.com", "analytics.tiktok.com", "ads.pinterest.com",
)
LIVE_HIGH_RISK = ("doubleclick.net", "connect.facebook.net", "facebook.net", "fingerprintjs.com", "fpjs.io",
                  "hotjar.com", "fullstory.com", "criteo.com", "quantserve.com", "adnxs.com")

# A pixel nobody knows.
UNKNOWN_PIXEL_CATEGORY = "Advertising / Analytics"
UNKNOWN_PIXEL_RISK = "medium"
PIXEL_WORDS = ("pixel", "beacon", "track", "1x1")
URL_PREVIEW = 200
MAX_HOSTS = 50
