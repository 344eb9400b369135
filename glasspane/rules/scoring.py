"""Points, weights and bands of the privacy score."""

# Weights of the seven dimensions, in this order of addition.
WEIGHTS = (("data_collection", 0.20), ("sharing", 0.20), ("transparency", 0.15), ("rights", 0.15),
           ("retention", 0.12), ("dark_patterns", 0.10), ("technical", 0.08))

# Points.
RETENTION_SCORE = {"excellent": 100, "good": 80, "fair": 55, "poor": 30, "very_poor": 5, "unknown": 0}
DARK_PENALTY = {"high": 15, "medium": 8, "low": 4}
SENSITIVITY_POINTS = {"critical_special": 10, "critical": 8, "high": 4, "medium": 1, "low": 0}
GRADE_CUTS = ((85, "A"), (70, "B"), (50, "C"), (30, "D"))
RISK_CUTS = ((75, "low"), (50, "medium"), (30, "high"))
NO_POLICY_OVERALL = 5
UNREADABLE_DIMS = {"data_collection": 50, "sharing": 50, "transparency": 25, "rights": 50, "retention": 50,
                   "dark_patterns": 70}
UNREADABLE_TECHNICAL = ((0, 90), (3, 70), (8, 45))
UNREADABLE_MANY = 20
UNREADABLE_NO_DATA = 50

# Sentence per grade.
SUMMARIES = {
    "A": "Strong privacy practices. Policy is transparent, rights are covered, and data collection is proportionate.",
    "B": "Good privacy practices with some areas for improvement. Generally compliant with major privacy regulations.",
    "C": "Average privacy posture. Several concerning practices detected. Review the detailed findings.",
    "D": "Poor privacy practices. Significant compliance gaps and risky data handling detected.",
    "F": "Very poor privacy practices. Major violations detected across multiple dimensions.",
}
NO_POLICY_SUMMARY = "No privacy policy found. This is a major compliance violation under GDPR and CCPA."
UNREADABLE_SUMMARY = ("Privacy policy page found but rendered via JavaScript — full text analysis was not possible. "
                      "Tracker and cookie analysis is available. Score reflects partial data.")
