"""Storage periods: how they are written, and how long is long."""

# Days per unit, and written numbers.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365, "yr": 365}
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
                "ten": 10, "twelve": 12, "twenty": 20, "thirty": 30, "ninety": 90}

# Period grammar. Plurals come first, so the captured text keeps its "s".
PERIOD = (r"(?:\d+(?:\.\d+)?)\s*(?:days?|weeks?|months?|years?|yrs?)"
          r"|(?:one|two|three|four|five|six|seven|eight|nine|ten|twelve|twenty|thirty|ninety)\s+"
          r"(?:days?|weeks?|months?|years?)")
KEPT_FOR = (r"(?:retain|keep|store|maintain|hold|preserve)\w*\s+(?:for\s+)?"
            r"(?:up\s+to\s+|at\s+least\s+|approximately\s+)?")
LASTS_FOR = r"(?:for\s+(?:up\s+to\s+)?)"

# Events that end storage, with their labels.
EVENTS = (
    (r"(?:until|upon|after|following)\s+account\s+(?:deletion|closure|termination|cancellation)",
     "Until account deletion"),
    (r"(?:when|once)\s+(?:you\s+)?(?:delete|close|terminate|cancel)\s+(?:your\s+)?account", "Until account deletion"),
    (r"(?:until|upon)\s+(?:your\s+)?request", "Until user requests deletion"),
    (r"upon\s+(?:written\s+)?request", "Upon request"),
    (r"within\s+\d+\s+(?:days?|months?)\s+of\s+(?:your\s+)?request", "Within defined period of request"),
    (r"(?:after|following)\s+(?:the\s+end\s+of\s+)?(?:our\s+)?(?:business\s+)?relationship",
     "After relationship ends"),
    (r"(?:upon|after)\s+(?:the\s+)?(?:expiry|expiration)\s+of\s+(?:the\s+)?(?:contract|agreement)",
     "After contract expiry"),
    (r"(?:as\s+long\s+as\s+)?(?:your\s+)?account\s+(?:is\s+)?(?:active|open|exists)", "While account is active"),
    (r"last\s+active", "Based on last activity"),
)

# Wording that names no period.
VAGUE = (
    r"as long as (?:reasonably )?necessary",
    r"as needed",
    r"for (?:a )?reasonable (?:period|time|amount of time)",
    r"in accordance with (?:applicable )?law",
    r"until (?:no longer |it is )?necessary",
    r"for (?:the )?purposes? (?:described|outlined|set out)",
    r"for (?:an )?extended period",
    r"on (?:an )?ongoing basis",
    r"indefinitely",
    r"at our (?:sole )?discretion",
    r"until we (?:no longer )?need",
    r"for (?:business|legal|operational) purposes",
)
VAGUE_TEXT = "Vague / Unspecified"
VAGUE_LABEL = "No specific period"
EVENT_LABEL = "Event-based deletion"

# Document-level flags.
DELETION_ON_REQUEST = (r"(?:delete|remove|erase)\w*\s+(?:your\s+)?(?:data|information|account)"
                       r"(?:\s+upon|\s+on|\s+at|\s+following)\s+(?:your\s+)?request")
STORAGE_LIMITATION = r"(?:storage\s+limitation|data\s+minimiz|purpose\s+limitation|no\s+longer\s+necessary)"
INDEFINITE = r"\bindefinitely\b"

# Rating bands (days up to, rating, label), points per rating, and mean cuts.
BANDS = ((30, "excellent", "≤ 30 days"), (180, "good", "1–6 months"), (365, "fair", "6–12 months"),
         (730, "poor", "1–2 years"))
RATING_POINTS = {"excellent": 5, "good": 4, "fair": 3, "poor": 2, "very_poor": 1, "unknown": 0}
MEAN_CUTS = ((4.5, "excellent"), (3.5, "good"), (2.5, "fair"), (1.5, "poor"))
WINDOW = (80, 80)
MAX_ITEMS = 20
