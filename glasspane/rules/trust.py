"""What is known about frequent recipients."""

# Name, category, trust 0-100, GDPR compliant, US based, data broker, typical data, purposes,
# opt-out address, privacy page.
PARTIES = (
    ("google llc", "Analytics / Advertising", 45, True, True, False, ("IP address", "Device ID", "Browsing behavior", "Location", "Search history"), ("analytics", "advertising"), "https://adssettings.google.com/", "https://policies.google.com/privacy"),
    ("google", "Analytics / Advertising", 45, True, True, False, ("IP address", "Device data", "Behavioral data"), ("analytics", "advertising"), "https://adssettings.google.com/", "https://policies.google.com/privacy"),
    ("google analytics", "Analytics", 50, True, True, False, ("IP address", "Session data", "Page views", "Events"), ("analytics",), "https://tools.google.com/dlpage/gaoptout", "https://policies.google.com/privacy"),
    ("meta", "Social / Advertising", 30, True, True, True, ("Profile data", "Behavioral data", "Location", "Content interactions", "Financial data"), ("advertising", "social_media"), "https://www.facebook.com/ads/preferences/", "https://www.facebook.com/policy"),
    ("facebook", "Social / Advertising", 30, True, True, True, ("Profile data", "Behavioral data", "Location", "Device data"), ("advertising", "social_media"), "https://www.facebook.com/ads/preferences/", "https://www.facebook.com/policy"),
    ("instagram", "Social / Advertising", 30, True, True, False, ("Photos", "Behavioral data", "Location"), ("advertising", "social_media"), None, "https://help.instagram.com/519522125107875"),
    ("stripe", "Payment Processing", 80, True, True, False, ("Payment card data", "Bank account", "Identity", "Transaction data"), ("payment", "fraud_detection"), None, "https://stripe.com/privacy"),
    ("paypal", "Payment Processing", 70, True, True, False, ("Payment data", "Identity", "Transaction history"), ("payment",), None, "https://www.paypal.com/us/legalhub/privacy-full"),
    ("braintree", "Payment Processing", 75, True, True, False, ("Payment card data", "Transaction data"), ("payment",), None, "https://www.braintreepayments.com/legal/braintree-privacy-policy"),
    ("stripe inc.", "Payment Processing", 80, True, True, False, ("Payment data",), ("payment",), None, "https://stripe.com/privacy"),
    ("amazon web services", "Cloud Infrastructure", 75, True, True, False, ("Server logs", "Stored data (as controller's processor)"), ("hosting",), None, "https://aws.amazon.com/privacy/"),
    ("aws", "Cloud Infrastructure", 75, True, True, False, ("Server logs", "Infrastructure data"), ("hosting",), None, "https://aws.amazon.com/privacy/"),
    ("cloudflare", "CDN / Security", 78, True, True, False, ("IP address", "Request logs", "Performance data"), ("hosting",), None, "https://www.cloudflare.com/privacypolicy/"),
    ("microsoft", "Technology", 60, True, True, False, ("Account data", "Usage data", "Telemetry"), ("analytics", "advertising"), "https://account.microsoft.com/privacy/", "https://privacy.microsoft.com/"),
    ("apple", "Technology", 85, True, True, False, ("Device data", "App usage", "Purchase history"), ("analytics",), None, "https://www.apple.com/legal/privacy/"),
    ("salesforce", "CRM / Marketing", 68, True, True, False, ("Customer data", "Email data", "Behavioral data"), ("analytics", "email_marketing"), None, "https://www.salesforce.com/company/privacy/"),
    ("hubspot", "Marketing Automation", 65, True, True, False, ("Email data", "Form submissions", "Behavioral data"), ("email_marketing", "analytics"), None, "https://legal.hubspot.com/privacy-policy"),
    ("mailchimp", "Email Marketing", 65, True, True, False, ("Email address", "Name", "Email open/click data"), ("email_marketing",), None, "https://mailchimp.com/legal/privacy/"),
    ("klaviyo", "Email Marketing", 62, True, True, False, ("Email address", "Behavioral data", "Purchase history"), ("email_marketing",), None, "https://www.klaviyo.com/legal/privacy-notice"),
    ("twilio", "Communications", 70, True, True, False, ("Phone number", "SMS content", "Email data"), ("email_marketing",), None, "https://www.twilio.com/legal/privacy"),
    ("sendgrid", "Email Delivery", 70, True, True, False, ("Email address", "Email content", "Delivery data"), ("email_marketing",), None, "https://www.twilio.com/legal/privacy"),
    ("zendesk", "Customer Support", 72, True, True, False, ("Support tickets", "Contact info", "Conversation history"), ("customer_support",), None, "https://www.zendesk.com/company/agreements-and-terms/privacy-notice/"),
    ("intercom", "Customer Support / Marketing", 65, True, True, False, ("Contact info", "Behavioral data", "Conversation history"), ("customer_support", "analytics"), None, "https://www.intercom.com/legal/privacy"),
    ("drift", "Conversational Marketing", 60, True, True, False, ("Contact info", "Chat content", "Behavioral data"), ("customer_support", "analytics"), None, "https://www.drift.com/privacy-policy/"),
    ("hotjar", "Session Recording / Heatmaps", 45, True, False, False, ("Mouse movements", "Clicks", "Scrolls", "Form inputs (potentially)"), ("analytics",), "https://www.hotjar.com/legal/compliance/opt-out", "https://www.hotjar.com/legal/policies/privacy/"),
    ("mixpanel", "Analytics", 60, True, True, False, ("Events", "User properties", "Device data"), ("analytics",), "https://mixpanel.com/optout", "https://mixpanel.com/legal/privacy-policy/"),
    ("amplitude", "Analytics", 62, True, True, False, ("Events", "User properties", "Behavioral data"), ("analytics",), None, "https://amplitude.com/privacy"),
    ("segment", "Customer Data Platform", 60, True, True, False, ("Events", "User traits", "Identity data"), ("analytics",), None, "https://www.twilio.com/legal/privacy"),
    ("fullstory", "Session Recording", 40, True, True, False, ("Full session replay", "Clicks", "Scrolls", "User inputs"), ("analytics",), "https://www.fullstory.com/optout", "https://www.fullstory.com/legal/privacy-policy"),
    ("criteo", "Advertising", 25, True, True, True, ("Browsing history", "Purchase intent", "Device data"), ("advertising",), "https://www.criteo.com/privacy/disable-criteo-services-on-internet/", "https://www.criteo.com/privacy/"),
    ("twitter", "Social / Advertising", 40, True, True, False, ("Social profile", "Behavioral data", "Device data"), ("advertising", "social_media"), "https://twitter.com/settings/personalization", "https://twitter.com/en/privacy"),
    ("linkedin", "Professional Social / Advertising", 55, True, True, False, ("Professional profile", "Behavioral data", "Company data"), ("advertising", "analytics"), "https://www.linkedin.com/psettings/guest-controls/retargeting-opt-out", "https://www.linkedin.com/legal/privacy-policy"),
    ("adroll", "Advertising", 30, True, True, True, ("Browsing behavior", "Device data", "Purchase intent"), ("advertising",), "https://app.adroll.com/optout/safari", "https://www.adroll.com/about/privacy"),
    ("optimizely", "A/B Testing", 68, True, True, False, ("Experiment assignment", "Page views", "Conversion events"), ("analytics",), None, "https://www.optimizely.com/legal/privacy/"),
    ("adobe", "Analytics / Marketing", 60, True, True, False, ("Behavioral data", "Campaign data", "Analytics data"), ("analytics", "advertising"), None, "https://www.adobe.com/privacy.html"),
    ("tiktok", "Social / Advertising", 20, False, False, False, ("Device data", "Behavioral data", "Location", "Content interactions"), ("advertising", "social_media"), None, "https://www.tiktok.com/legal/page/us/privacy-policy/en"),
    ("marketo", "Marketing Automation", 62, True, True, False, ("Email data", "Form submissions", "Lead score"), ("email_marketing", "analytics"), None, "https://www.adobe.com/privacy/marketing-cloud.html"),
)

# Documentation pages of frequent recipients, by label.
COMPANY_PAGES = {
    "google": {"privacy": "https://policies.google.com/privacy", "security": "https://safety.google/", "dpa": "https://cloud.google.com/terms/data-processing-addendum", "trust": "https://cloud.google.com/security/compliance", "sub_processors": "https://cloud.google.com/terms/subprocessors"},
    "google llc": {"privacy": "https://policies.google.com/privacy", "security": "https://safety.google/", "dpa": "https://cloud.google.com/terms/data-processing-addendum", "trust": "https://cloud.google.com/security/compliance"},
    "google analytics": {"privacy": "https://policies.google.com/privacy", "security": "https://support.google.com/analytics/answer/6004245", "dpa": "https://business.safety.google/adsprocessorterms/", "opt_out": "https://tools.google.com/dlpage/gaoptout"},
    "meta": {"privacy": "https://www.facebook.com/privacy/policy/", "security": "https://www.facebook.com/security", "dpa": "https://www.facebook.com/legal/EU_data_transfer_addendum", "trust": "https://www.facebook.com/help/safetycenter/", "sub_processors": "https://www.facebook.com/legal/ads-subprocessors"},
    "facebook": {"privacy": "https://www.facebook.com/privacy/policy/", "security": "https://www.facebook.com/security", "dpa": "https://www.facebook.com/legal/EU_data_transfer_addendum"},
    "stripe": {"privacy": "https://stripe.com/privacy", "security": "https://stripe.com/docs/security", "dpa": "https://stripe.com/legal/dpa", "trust": "https://stripe.com/docs/security/stripe", "sub_processors": "https://stripe.com/legal/service-providers", "certifications": "PCI-DSS Level 1, SOC 1 & 2, ISO 27001"},
    "paypal": {"privacy": "https://www.paypal.com/us/legalhub/privacy-full", "security": "https://www.paypal.com/us/webapps/mpp/security/security-home", "dpa": "https://www.paypal.com/us/legalhub/paypal-data-processing-agreement"},
    "hotjar": {"privacy": "https://www.hotjar.com/legal/policies/privacy/", "security": "https://help.hotjar.com/hc/en-us/articles/115011639587", "dpa": "https://www.hotjar.com/legal/support-and-security/data-processing-agreement/", "trust": "https://www.hotjar.com/legal/compliance/", "opt_out": "https://www.hotjar.com/legal/compliance/opt-out"},
    "fullstory": {"privacy": "https://www.fullstory.com/legal/privacy-policy", "security": "https://www.fullstory.com/legal/security", "dpa": "https://www.fullstory.com/legal/dpa", "trust": "https://www.fullstory.com/security/", "opt_out": "https://www.fullstory.com/optout"},
    "mixpanel": {"privacy": "https://mixpanel.com/legal/privacy-policy/", "security": "https://mixpanel.com/legal/security/", "dpa": "https://mixpanel.com/legal/data-processing-agreement/", "sub_processors": "https://mixpanel.com/legal/mixpanel-subprocessors/"},
    "amplitude": {"privacy": "https://amplitude.com/privacy", "security": "https://amplitude.com/security", "dpa": "https://amplitude.com/data-privacy-framework", "trust": "https://amplitude.com/trust", "sub_processors": "https://amplitude.com/amplitude-subprocessors"},
    "segment": {"privacy": "https://www.twilio.com/legal/privacy", "security": "https://www.twilio.com/en-us/security", "dpa": "https://www.twilio.com/legal/data-protection-addendum", "trust": "https://www.twilio.com/en-us/trust-center", "sub_processors": "https://www.twilio.com/legal/sub-processors"},
    "hubspot": {"privacy": "https://legal.hubspot.com/privacy-policy", "security": "https://legal.hubspot.com/security", "dpa": "https://legal.hubspot.com/dpa", "trust": "https://trust.hubspot.com/", "sub_processors": "https://legal.hubspot.com/sub-processors"},
    "mailchimp": {"privacy": "https://mailchimp.com/legal/privacy/", "security": "https://mailchimp.com/about/security/", "dpa": "https://mailchimp.com/legal/data-processing-addendum/", "sub_processors": "https://mailchimp.com/legal/subprocessors/"},
    "salesforce": {"privacy": "https://www.salesforce.com/company/privacy/", "security": "https://www.salesforce.com/products/platform/best-practices/security/", "dpa": "https://www.salesforce.com/content/dam/web/en_us/www/documents/legal/Agreements/data-processing-addendum.pdf", "trust": "https://trust.salesforce.com/", "certifications": "ISO 27001, SOC 1 & 2, PCI-DSS, HIPAA"},
    "zendesk": {"privacy": "https://www.zendesk.com/company/agreements-and-terms/privacy-notice/", "security": "https://www.zendesk.com/company/privacy-and-data-protection/", "dpa": "https://www.zendesk.com/company/agreements-and-terms/data-processing-agreement/", "trust": "https://www.zendesk.com/trust-center/", "sub_processors": "https://www.zendesk.com/company/agreements-and-terms/subprocessors/"},
    "intercom": {"privacy": "https://www.intercom.com/legal/privacy", "security": "https://www.intercom.com/legal/security", "dpa": "https://www.intercom.com/legal/data-processing-agreement", "trust": "https://www.intercom.com/security", "sub_processors": "https://www.intercom.com/legal/subprocessors"},
    "criteo": {"privacy": "https://www.criteo.com/privacy/", "security": "https://www.criteo.com/privacy/security/", "opt_out": "https://www.criteo.com/privacy/disable-criteo-services-on-internet/"},
    "twilio": {"privacy": "https://www.twilio.com/legal/privacy", "security": "https://www.twilio.com/en-us/security", "dpa": "https://www.twilio.com/legal/data-protection-addendum", "trust": "https://www.twilio.com/en-us/trust-center", "certifications": "SOC 2, ISO 27001, PCI-DSS"},
    "microsoft": {"privacy": "https://privacy.microsoft.com/en-us/privacystatement", "security": "https://www.microsoft.com/en-us/trust-center/security", "dpa": "https://www.microsoft.com/en-us/licensing/docs/view/Microsoft-Products-and-Services-Data-Protection-Addendum-DPA", "trust": "https://www.microsoft.com/en-us/trust-center", "certifications": "ISO 27001, SOC 1 & 2, PCI-DSS, HIPAA, FedRAMP"},
    "amazon web services": {"privacy": "https://aws.amazon.com/privacy/", "security": "https://aws.amazon.com/security/", "dpa": "https://d1.awsstatic.com/legal/aws-dpa/aws-dpa.pdf", "trust": "https://aws.amazon.com/compliance/", "sub_processors": "https://aws.amazon.com/compliance/sub-processors/", "certifications": "SOC 1/2/3, ISO 27001, PCI-DSS, HIPAA, FedRAMP"},
    "cloudflare": {"privacy": "https://www.cloudflare.com/privacypolicy/", "security": "https://www.cloudflare.com/security-policy/", "dpa": "https://www.cloudflare.com/cloudflare-customer-dpa/", "trust": "https://www.cloudflare.com/trust-hub/", "certifications": "SOC 2, ISO 27001, PCI-DSS"},
    "tiktok": {"privacy": "https://www.tiktok.com/legal/page/us/privacy-policy/en", "security": "https://www.tiktok.com/safety/en/", "trust": "https://www.tiktok.com/transparency"},
    "klaviyo": {"privacy": "https://www.klaviyo.com/legal/privacy-notice", "security": "https://www.klaviyo.com/security", "dpa": "https://www.klaviyo.com/legal/data-processing-agreement", "sub_processors": "https://www.klaviyo.com/legal/subprocessors"},
    "optimizely": {"privacy": "https://www.optimizely.com/legal/privacy/", "security": "https://www.optimizely.com/security/", "dpa": "https://www.optimizely.com/legal/dpa/"},
    "adobe": {"privacy": "https://www.adobe.com/privacy/policy.html", "security": "https://www.adobe.com/trust/compliance/adobe-ccf.html", "dpa": "https://www.adobe.com/content/dam/cc/en/legal/terms/enterprise/pdfs/DPCC-EE-en-US-20231108.pdf", "trust": "https://www.adobe.com/trust.html", "certifications": "SOC 2, ISO 27001, FedRAMP"},
    "adroll": {"privacy": "https://www.adroll.com/about/privacy", "opt_out": "https://app.adroll.com/optout/safari"},
    "linkedin": {"privacy": "https://www.linkedin.com/legal/privacy-policy", "security": "https://security.linkedin.com/", "dpa": "https://www.linkedin.com/legal/data-processing-agreement"},
    "twitter": {"privacy": "https://twitter.com/en/privacy", "security": "https://help.twitter.com/en/safety-and-security", "opt_out": "https://twitter.com/settings/personalization"},
    "sendgrid": {"privacy": "https://www.twilio.com/legal/privacy", "security": "https://www.twilio.com/en-us/security", "dpa": "https://www.twilio.com/legal/data-protection-addendum", "certifications": "SOC 2, ISO 27001"},
    "logrocket": {"privacy": "https://logrocket.com/privacy/", "security": "https://logrocket.com/security/", "dpa": "https://logrocket.com/dpa/"},
    "heap": {"privacy": "https://heap.io/privacy", "security": "https://heap.io/security", "dpa": "https://heap.io/dpa"},
}

# Labels in order, the words that reveal them in a link, and sizes.
PAGE_LABELS = ("privacy", "security", "dpa", "trust", "sub_processors")
LABEL_WORDS = {
    "privacy": ("privacy", "datenschutz", "confidentialit"),
    "security": ("security", "safety", "sicherheit"),
    "dpa": ("data-processing", "dpa", "data-protection-addendum", "gdpr"),
    "trust": ("trust", "compliance", "certifications"),
    "sub_processors": ("sub-processor", "subprocessor", "third-party-service"),
}
PAGES_PER_PARTY = 3
PARTIES_PER_SITE = 12
PAGE_CHARS = 6000
DOSSIER_CHARS = 2000
