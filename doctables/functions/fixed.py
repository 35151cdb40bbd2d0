"""They must equal the documented ones for results to match."""

# Text that stands for a missing value (compared in lower case).
NULL_TOKENS = (
    "", "n/a", "na", "null", "none", "-", "--", "nil", "unknown", "undefined", "#n/a", "nan",
)

# Ligatures and their expansion.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "æ": "ae"}

# Characters without width (zero-width space and joiners, BOM, soft hyphen).
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"

# Typographic characters and their ASCII form.
TYPOGRAPHIC = {
    "\u00a0": " ", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-",
}

# Province spellings and names.
PROVINCES = {
    "gp": "Gauteng", "gau": "Gauteng", "gauteng": "Gauteng",
    "kzn": "KwaZulu-Natal", "kwazulu-natal": "KwaZulu-Natal",
    "wc": "Western Cape", "western cape": "Western Cape",
    "ec": "Eastern Cape", "eastern cape": "Eastern Cape",
    "fs": "Free State", "free state": "Free State",
    "mp": "Mpumalanga", "mpu": "Mpumalanga", "mpumalanga": "Mpumalanga",
    "lp": "Limpopo", "lim": "Limpopo", "limpopo": "Limpopo",
    "nw": "North West", "north west": "North West",
    "nc": "Northern Cape", "northern cape": "Northern Cape",
    "national": "National",
}

# Words for true and false.
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")

# Parts of a field name that mark codes and provinces.
CODE_TERMS = ("id", "code", "ofo", "saqa")
PROVINCE_TERMS = ("province", "prov", "region")

# List items that are no names.
LIST_STOPWORDS = (
    "college", "colleges", "tvet", "tvet college", "tvet colleges", "participating",
    "participating colleges", "participating tvet colleges", "none", "nil", "n/a", "na", "no",
    "-", "--",
)

# Lines that continue the item above them.
GLUE_WORDS = ("college", "colleges", "tvet", "tvet college", "tvet colleges", "campus")
GLUE_PREFIXES = ("college", "campus")

# Funding words.
ELIGIBLE_WORDS = ("YES", "ELIGIBLE", "FUNDED", "TRUE", "1", "Y")
NOT_ELIGIBLE_WORDS = ("NO", "NOT ELIGIBLE", "UNFUNDED", "FALSE", "0", "N")

# Allowed values of the relational columns.
ALLOWED_NSFAS = ("YES", "NO")
ALLOWED_CONFIDENCE = ("high", "medium", "low")
ALLOWED_FRAMEWORKS = ("OQSF", "HEQSF", "GFETQSF")
ALLOWED_QUALITY_FLAGS = ("review_possible_variant",)

# List columns known by name.
KNOWN_LIST_COLUMNS = (
    "participating_colleges", "colleges", "institutions", "provinces", "categories",
)

# Identifier fields, best first, for reconciliation and evaluation.
RECONCILE_ID_FIELDS = (
    "saqa_id", "ofo_code", "occupation_code", "code", "id", "variable", "var_name",
)
RECONCILE_TITLE_FIELDS = (
    "qualification_title", "qualification_name", "occupation_title", "title", "name",
)
GOLDEN_ID_FIELDS = (
    "saqa_id", "ofo_code", "occupation_code", "code", "id", "variable", "var_name",
    "qualification_title", "occupation_title", "title",
)

# Fields that describe a record and are never compared.
META_FIELDS = ("source_page", "confidence", "issues", "field_provenance")

# Header words of the two list layouts and what a missing cell holds.
QUALIFICATION_ALIASES = {
    "saqa_id": ("saqa", "qual id", "qualification id", "code", "qual code", "id"),
    "qualification": (
        "qualification", "learning programme", "programme", "title", "description",
        "qual title", "occupational qualification",
    ),
    "nqf_level": ("nqf", "level", "nqf level"),
    "framework": ("sub-framework", "framework", "subframework", "qualification type", "type"),
    "nsfas_eligible": ("nsfas", "funded", "bursary", "eligible", "nsfas eligible"),
    "participating_colleges": (
        "college", "colleges", "delivery centre", "offering", "institution", "campus", "tvet",
        "provider",
    ),
}
QUALIFICATION_DEFAULTS = {"nsfas_eligible": "No"}
QUALIFICATION_HEADER_WORDS = ("saqa", "qual id", "national qual")
OCCUPATION_ALIASES = {
    "ofo_code": ("ofo", "code", "ofo code", "occupation code", "unit group", "unit"),
    "occupation_title": (
        "occupation", "title", "occupation title", "description", "job title", "name",
    ),
    "demand_rank": ("rank", "ranking", "demand", "priority", "demand rank", "priority level"),
    "major_group": ("major group", "group", "sub-major", "ofo group", "occupational group"),
    "province": ("province", "region", "provincial", "location", "prov"),
    "educational_qualification_req": (
        "qualification", "entry requirement", "education", "minimum qualification", "requirement",
    ),
}
OCCUPATION_DEFAULTS = {"demand_rank": "1", "province": "National"}
OCCUPATION_HEADER_WORDS = ("ofo", "code", "occupation")
CODEBOOK_FIELDS = (
    "variable_name", "variable_label", "value", "value_label", "data_type", "description",
)
