"""What a site's analysis says where no model answer can be read."""

# Texts of the fallback by field; {domain}, {grade} and {score} are the site's.
FALLBACK = {
    "tldr": "{domain} scored {score}/100 — AI analysis unavailable.",
    "plain_summary": "{domain} has a privacy grade of {grade} ({score}/100).",
    "user_rights_summary": "AI analysis unavailable.",
    "risk_narrative": "{domain} received a {grade} privacy grade ({score}/100). AI analysis is unavailable.",
    "data_story": "AI analysis unavailable.",
    "ai_score_commentary": "Score of {score}/100 based on automated analysis only.",
}
FALLBACK_RISKS = ("AI analysis unavailable",)

# What a company's dossier says where no page was read, where no answer came, where the answer is no JSON object (its start is the
# summary then), and where an answer lacks a field.
PARTY = {
    "unread": {"summary": None, "gdpr_role": "Unknown", "retention_claimed": "Not stated", "trust_score_ai": 30},
    "silent": {"summary": "AI analysis unavailable.", "gdpr_role": "Unknown", "retention_claimed": "Unknown", "trust_score_ai": 40},
    "unclear": {"summary": None, "gdpr_role": "Unknown", "retention_claimed": "Unknown", "trust_score_ai": 40},
    "answered": {"summary": "", "gdpr_role": "Unknown", "retention_claimed": "Not stated", "trust_score_ai": 40},
}
PARTY_UNREAD_FLAG = "No documentation accessible"
PARTY_SUMMARY_CHARS = 300
