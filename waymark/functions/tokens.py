"""Missing-value token sets, boolean dialects and administrative vocabularies.

Fixed values: these words decide which cells count as missing and must not change.
Comparison is on lower-cased, trimmed text unless a set is marked exact-case.
"""

BLANK = ("", "nan", "none", "null")

QUERY = BLANK + ("na",)
UPPER_NA = ("", "na")
SITE = BLANK + ("na", "n/a", "unknown", "not available", "no data")
COORD = BLANK + ("na", "n/a", "unknown")
SCREEN = BLANK + (
    "unknown", "missing", "not available", "not provided", "no data", "n/a", "na",
)
SCREEN_KEEP_NA = ("na", "n/a")
ADMIN = BLANK + (
    "na", "n/a", "unknown", "unk", "missing", "not known", "not specified",
    "no data", "no locality", "-", "--", "?",
)
CENTROID = BLANK + (
    "na", "n/a", "unknown", "unrecoverable", "not available", "no data",
    "no locality", "not specified", "unspecified",
)
LABEL = BLANK + ("na", "n/a", "<na>")
POOL = BLANK + ("na", "<na>")
PILOT = BLANK + ("na",)
TRUTH = BLANK + ("na", "<na>")
FULL = BLANK + ("na", "n/a", "<missing>")

# exact-case sets
VALID_EXACT = ("", "N/A", "NA", "nan", "None", "<NA>")
REVIEW_EXACT = ("", "nan", "NaN", "None", "<NA>")

# boolean dialects
TRUE_LOOKUP = ("true", "1", "yes", "y")
TRUE_MERGE = TRUE_LOOKUP + ("success",)
TRUE_STRICT = ("true", "1", "yes")
FALSE_STRICT = ("false", "0", "no")
TRUE_FLAG = ("true", "t", "1", "yes", "y")
FALSE_FLAG = ("false", "f", "0", "no", "n")

# words removed around an administrative name
ADMIN_PREFIXES = ("province of", "state of", "region of", "department of")
ADMIN_SUFFIXES = (
    "province", "state", "region", "territory", "governorate", "prefecture",
    "department", "county", "district", "oblast",
)

# country labels that always go to review
REVIEW_COUNTRIES = (
    "ussr", "soviet union", "yugoslavia", "czechoslovakia", "zaire",
    "netherlands antilles", "serbia and montenegro", "west germany",
    "east germany", "antarctica",
)

# country codes missing from code columns of some administrative layers
CODE_ALIASES = {"GF": "GUF", "GP": "GLP", "RE": "REU", "XK": "KOS"}

# exact country-name aliases
COUNTRY_ALIASES = {
    "bolivia": "BOL", "brunei": "BRN", "cape verde": "CPV", "cabo verde": "CPV",
    "congo": "COG", "republic of congo": "COG", "congo brazzaville": "COG",
    "democratic republic of congo": "COD", "democratic republic of the congo": "COD",
    "dr congo": "COD", "drc": "COD", "congo kinshasa": "COD",
    "cote d ivoire": "CIV", "ivory coast": "CIV", "czech republic": "CZE",
    "czechia": "CZE", "east timor": "TLS", "timor leste": "TLS", "iran": "IRN",
    "laos": "LAO", "moldova": "MDA", "north korea": "PRK", "south korea": "KOR",
    "korea north": "PRK", "korea south": "KOR", "palestine": "PSE",
    "russia": "RUS", "russian federation": "RUS", "syria": "SYR", "taiwan": "TWN",
    "tanzania": "TZA", "the bahamas": "BHS", "bahamas": "BHS", "the gambia": "GMB",
    "gambia": "GMB", "turkey": "TUR", "turkiye": "TUR", "uk": "GBR", "u k": "GBR",
    "great britain": "GBR", "united kingdom": "GBR", "usa": "USA", "u s a": "USA",
    "us": "USA", "u s": "USA", "united states": "USA",
    "united states of america": "USA", "venezuela": "VEN", "vietnam": "VNM",
    "viet nam": "VNM", "micronesia": "FSM", "swaziland": "SWZ", "eswatini": "SWZ",
    "macedonia": "MKD", "north macedonia": "MKD", "burma": "MMR", "myanmar": "MMR",
    "sao tome and principe": "STP", "french guiana": "GUF", "guadeloupe": "GLP",
    "reunion": "REU", "la reunion": "REU", "falkland islands": "FLK",
    "falkland islands islas malvinas": "FLK", "kosovo": "KOS",
}
