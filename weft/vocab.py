"""Closed vocabularies of the clothing domain.

Everything in this module is data: the column builders in ``weft.functions``
turn it into Spark expressions.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Catalog columns.
# ---------------------------------------------------------------------------
REQUIRED_COLUMNS = (
    "product_id", "product_name", "category", "subcategory", "gender", "color",
    "size", "fit", "material", "brand", "price_inr", "rating", "season",
    "description",
)
NUMERIC_COLUMNS = ("price_inr", "rating")
TEXT_COLUMNS = tuple(c for c in REQUIRED_COLUMNS if c not in NUMERIC_COLUMNS)
LINK_COLUMNS = ("product_url", "product_link", "url", "website_url")
DEFAULT_RATING = 4.0

# Field texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ---------------------------------------------------------------------------
# Attribute vocabularies. The order is the match order.
# ---------------------------------------------------------------------------
CATEGORIES = (
    "shirts", "t-shirts", "jeans", "trousers", "dresses", "skirts", "jackets",
    "hoodies", "sweaters", "tops", "shorts", "ethnic wear", "activewear",
)
GENDERS = ("Men", "Women", "Unisex")
FITS = ("Slim Fit", "Regular Fit", "Relaxed Fit", "Oversized", "Skinny Fit")
MATERIALS = (
    "Cotton", "Denim", "Polyester", "Linen", "Wool", "Silk", "Rayon", "Leather",
)
COLORS = (
    "Black", "Blue", "White", "Red", "Green", "Navy", "Grey", "Beige", "Yellow",
    "Pink", "Olive", "Maroon", "Brown", "Purple", "Orange",
)
SEASONS = ("Summer", "Winter", "Spring", "Autumn", "All-Season")
ANY_GENDER = "unisex"
ANY_SEASON = "all-season"

# Words that name a category. Longer words win; words of equal
# length are tried in this order.
CATEGORY_WORDS = {
    "jeans": ("jeans", "jean", "denim", "denims"),
    "t-shirts": (
        "t-shirt", "t-shirts", "tshirt", "tshirts", "tee", "tees", "polo", "polos",
    ),
    "shirts": ("shirt", "shirts"),
    "trousers": (
        "trouser", "trousers", "pant", "pants", "chinos", "slacks", "cargo",
        "cargos", "legging", "leggings", "jogger", "joggers", "sweatpants",
        "bottoms",
    ),
    "dresses": (
        "dress", "dresses", "maxi dress", "maxi dresses", "frock", "frocks",
        "gown", "gowns",
    ),
    "skirts": ("skirt", "skirts"),
    "jackets": (
        "jacket", "jackets", "blazer", "blazers", "coat", "coats", "overcoat",
        "overcoats",
    ),
    "hoodies": ("hoodie", "hoodies", "sweatshirt", "sweatshirts"),
    "sweaters": (
        "sweater", "sweaters", "cardigan", "cardigans", "pullover", "pullovers",
        "jumper", "jumpers",
    ),
    "tops": (
        "top", "tops", "blouse", "blouses", "tunic", "tunics", "crop top",
        "crop tops", "tank top", "tank tops",
    ),
    "shorts": ("short", "shorts"),
    "ethnic wear": (
        "kurta", "kurtas", "kurti", "kurtis", "ethnic", "ethnic wear", "saree",
        "sarees", "sari", "saris", "anarkali", "lehenga",
    ),
    "activewear": (
        "activewear", "sportswear", "gymwear", "workout", "gym", "track",
    ),
}
# The words that a formal or a men's "dress" request disables.
BARE_DRESS_WORDS = ("dress", "dresses")

# Words that name a fit, tried like the category words.
FIT_WORDS = {
    "Slim Fit": ("slim fit", "slim"),
    "Regular Fit": ("regular fit", "regular"),
    "Relaxed Fit": ("relaxed fit", "relaxed"),
    "Oversized": ("oversized", "oversize"),
    "Skinny Fit": ("skinny fit", "skinny"),
}

# Gender words, tried in this order.
GENDER_WORDS = {
    "Women": ("women", "woman", "women's", "womens", "ladies", "female", "girls"),
    "Men": ("men", "man", "men's", "mens", "guys", "male", "boys"),
    "Unisex": ("unisex",),
}

# Extra spellings of a color.
COLOR_SPELLINGS = {"Grey": ("grey", "gray")}

# Style words, tried in list order.
STYLES = (
    "maxi", "midi", "mini", "floral", "printed", "casual", "formal", "party",
    "solid", "striped", "sleeveless", "embroidered", "graphic", "summer",
    "office", "festive", "trendy", "comfortable", "stylish", "nice",
)

# Intent words, tried in this order.
INTENT_WORDS = {
    "party wear": ("party", "occasion", "wedding"),
    "formal wear": ("formal", "office"),
    "casual wear": ("casual", "everyday"),
    "summer clothing": ("summer",),
    "sportswear": ("sport", "sports", "gym", "workout"),
    "budget clothing": ("affordable", "budget", "cheap", "inexpensive"),
    "broad clothing": (
        "outfit", "clothing", "clothes", "apparel", "something", "wear",
    ),
}
BROAD_INTENT = "broad clothing"
# Intents that say nothing about the occasion.
UNSPECIFIC_INTENTS = ("broad clothing", "budget clothing")
# The intent a style stands for.
STYLE_INTENT = {
    "formal": "formal wear",
    "office": "office wear",
    "casual": "casual wear",
    "party": "party wear",
    "summer": "summer clothing",
    "festive": "occasion wear",
}
# The style an intent is ranked by.
INTENT_STYLE = {
    "formal wear": "formal",
    "office wear": "office",
    "casual wear": "casual",
    "party wear": "party",
    "occasion wear": "festive",
    "summer clothing": "summer",
    "sportswear": "sports",
}
# Product text that shows a style. A style without an entry is
# shown by its own name.
STYLE_EVIDENCE = {
    "formal": ("formal", "office", "tailored", "blazer"),
    "casual": ("casual", "everyday", "resort", "relaxed"),
    "party": ("party", "evening", "festive"),
    "summer": ("summer", "sun", "beach"),
    "office": ("office", "formal", "tailored", "blazer"),
    "festive": ("festive", "ethnic", "evening"),
}
# The style of a query that names neither style nor intent.
NO_STYLE = "none"

# Words that mark a search as one about clothing (regex syntax,
# each matched as a whole word).
DOMAIN_WORDS = (
    "jeans?", "denims?", "t[- ]?shirts?", "tshirts?", "tees?", "polos?",
    "shirts?", "dress(?:es)?", "maxi", "frocks?", "gowns?", "hoodies?",
    "sweatshirts?", "pullovers?", "jackets?", "blazers?", "coats?",
    "overcoats?", "windbreakers?", "sweaters?", "cardigans?", "jumpers?",
    "tops?", "crop[- ]?tops?", "tank[- ]?tops?", "blouses?", "tunics?",
    "skirts?", "trousers?", "pants?", "chinos?", "slacks?", "cargos?",
    "leggings?", "joggers?", "sweatpants?", "bottoms?", "shorts?", "kurtas?",
    "kurtis?", "sarees?", "saris?", "anarkalis?", "lehengas?", "suits?",
    "tuxedos?", "jumpsuits?", "rompers?", "activewear", "sportswear", "gymwear",
    "streetwear", "tracksuits?", "clothings?", "clothes", "apparels?",
    "outfits?", "attires?", "garments?", "fashions?", "wardrobes?",
    "party[- ]?wear", "casual[- ]?wear", "formal[- ]?wear", "ethnic[- ]?wear",
    "summer[- ]?wear", "winter[- ]?wear", "beach[- ]?wear", "daily[- ]?wear",
    "night[- ]?wear", "sleep[- ]?wear", "work[- ]?wear", "wear",
)
# Characters that carry no word of their own (regex class).
NON_TEXT = r"""[\d₹,.$%#@!*?&/\\()<>{}\[\]=+\-_:;"']"""

# Price phrases (regex syntax).
PRICE_NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
CURRENCY = r"(?:₹|rs\.?|inr|rupees)?"
MAX_PRICE_WORDS = (
    "under", "below", "less than", "within", "upto", "up to", "budget", "max",
    "<=", "<", "₹", r"rs\.?", "inr", "rupees",
)
MAX_PRICE_SUFFIXES = ("or less", "or below", "max")
MIN_PRICE_WORDS = (
    "above", "over", "from", "more than", "min", "minimum", ">=", ">",
)

# Dress phrases (regex syntax).
DRESS_SHIRT = r"\bdress\s+shirts?\b"
FORMAL_DRESS = r"\bformal(?:\s+\w+){0,3}\s+dress\b"

# Tokens dropped from the cleaned search text. Entries of two
# words never equal a single token; they are listed for completeness.
SEARCH_STOP_TOKENS = (
    "under", "below", "above", "over", "rs", "inr", "rupees", "less than",
    "more than", "budget", "upto", "up to", "for", "with", "a", "an", "the",
    "in",
)

# The characters of Unicode's White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Splitter delimiters, most wanted first.
SPLIT_DELIMITERS = (". ", "? ", "! ", "\n\n", "\n", ", ", " ")

# Defaults of the search.
CHUNK_SIZE = 400
CHUNK_OVERLAP = 50
TOP_K = 4
SCORE_THRESHOLD = 0.20
SEMANTIC_WEIGHT = 0.65
ATTRIBUTE_WEIGHT = 0.35
VECTOR_LENGTH = 384
MAX_TERMS = 10000
PRICE_SLIDER = (0, 6000)
ALL_OPTION = "All"

# Score of each attribute a query can ask for.
ATTRIBUTE_POINTS = {
    "category": 0.30,
    "color": 0.25,
    "fit": 0.20,
    "material": 0.15,
    "season": 0.10,
    "style": 0.20,
}

# Messages and source labels of a response.
MESSAGE_OK = "Success"
MESSAGE_NO_CANDIDATE = (
    "No matching products were found satisfying your specific budget or "
    "category requirements."
)
MESSAGE_BELOW_THRESHOLD = "No matching products met the similarity threshold."
SOURCE_SYSTEM = "System"
SOURCE_TEMPLATE = "Smart Fashion Engine (Local Fallback)"
TEXT_NO_ITEMS = (
    "No matching products found satisfying your search criteria and price "
    "limits. Try adjusting your search query or loosening sidebar filters."
)
TEXT_NO_EVIDENCE = (
    "No sufficiently supported recommendation was found in the retrieved "
    "product evidence."
)
# Evidence limits and explanation wording.
EXPLAINED_ITEMS = 2
EVIDENCE_CHUNKS = 3
EVIDENCE_CHARS = 1200
CONTEXT_CHARS = 12000
LEAST_RESPONSE_CHARS = 30
CITED_ID = r"\bPRD\d+\b"
EVIDENCE_FIELDS = (
    "product_id", "product_name", "category", "subcategory", "gender", "color",
    "size", "fit", "material", "brand", "price_inr", "rating", "season",
    "description",
)
REASON_FIRST = (
    "Recommended because it closely matches your request for %s and has a strong "
    "relevance score (%s%% Match)."
)
REASON_NEXT = (
    "Recommended because it matches your requested %s with high relevance to your "
    "search (%s%% Match)."
)

# Function words left out of the term vectors. This is the common core of an
# English stop list; callers with a longer list pass it as ``stop_words``.
TERM_STOP_WORDS = tuple("""
about above across after again against all almost alone along already also
although always am among an and another any anyone anything anywhere are around
as at be became because become been before behind being below beside besides
between beyond both but by can cannot could do done down due during each either
else elsewhere enough etc even ever every everyone everything everywhere except
few find first for former from full further get give go had has have he her here
hers herself him himself his how however if in indeed into is it its itself keep
last least less made many may me might more moreover most mostly much must my
myself neither never no nobody none nor not nothing now of off often on once one
only onto or other others our out over own per please put rather re same see
seem several she should show since so some someone something still such than
that the their them then there these they this those through to together too
toward two under until up us very was we well were what when where which while
who why will with within without would yet you your yourself
""".split())
