"""Fixed values that results depend on: word lists, patterns, message templates and table headers."""

#: Materials and colours known to the retrieval side, in the order in which they are tried.
MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "denim", "suede", "canvas", "linen", "fleece", "cashmere", "velvet")
COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange", "navy", "beige", "tan", "gold", "silver", "cream")

#: Those known to the customer simulator.
CARD_MATERIALS = ("cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric")
CARD_COLORS = ("black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange")

#: Words by which a constraint is put into a class, tried in this order after the budget pattern.
CONSTRAINT_CLASSES = {
    "material": CARD_MATERIALS,
    "color": ("color", "black", "white", "blue", "red", "pink", "green"),
    "size": ("size", "sizing", "width", "wide", "narrow"),
    "style": ("department", "style", "fit", "sleeve", "neck"),
    "use_case": ("hiking", "running", "gym", "winter", "outdoor", "work"),
}
#: Patterns of a budget that is mentioned, of its amount, and of sizes.
BUDGET_MENTION = r"(\$|<=|under)\s*\d"
BUDGET_AMOUNT = r"\$\s?(\d+(?:\.\d+)?)"
SIZE = r"\b(xx-?small|xx-?large|x-?small|x-?large|small|medium|large|xxs|xs|s|m|l|xl|xxl|size\s+\d{1,2}(?:\.\d)?|\d{1,2}(?:\.\d)?\s*(?:us|uk|eu))\b"

#: Words that a fielded search leaves out.
FIELDED_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some", "that", "the", "this", "to", "want", "with", "would", "you", "looking")
#: The English stop list of the plain lexical route.
ENGLISH_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
#: Weights of the fields in a fielded search.
FIELD_WEIGHTS = {"title": 6.0, "categories": 4.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}

#: Attributes that may be asked for, and the orders in which policies try them.
ATTRIBUTES = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")
#: Attributes held as slots.
SLOTS = ("material", "color", "size", "budget")
#: Attributes never asked for, those asked when slots are filled, and the order of the fixed policy.
NEVER_ASKED = ("brand", "category")
FALLBACK = ("style", "use_case", "feature", "other")
FIXED_ORDER = ("material", "color", "size", "budget", "style", "use_case", "feature")

#: Category names that say nothing about a product.
EXCLUDED_CATEGORIES = ("clothing", "clothing shoes & jewelry", "clothing, shoes & jewelry")
#: Fixed value: what stands for a category where none is told.
NO_CATEGORY = "clothing item"

#: Turns of a session, places that count, and the longest constraint, dense text and query.
MAX_TURNS, TOP_K, CONSTRAINT_CHARS, DENSE_CHARS, QUERY_TERMS = 10, 10, 180, 500, 40

#: Headers of the two report tables.
REPORT_HEADER = ("| Config | Hit@10 | MRR | MTTC | Efficiency | TechnicalScore | N |", "|---|---|---|---|---|---|---|")
SCENARIO_HEADER = ("| Config | Buying Hit@10 | Browsing Hit@10 | Intent Override Hit@10 | Boundary Hit@10 |", "|---|---|---|---|---|")
#: The scenarios, in the order of the report.
SCENARIOS = ("buying", "browsing", "intent_override", "boundary")

#: What a simulated customer says; {} stands for what is filled in.
OPENING = "I'm looking for {}"
OPENING_BUYING = ". A key requirement is: {}."
OPENING_OVERRIDE = ". {}"
OPENING_VAGUE = ", but I'm still exploring."
OVERRIDE = "Actually, ignore my earlier preference. What I need is: {}."
OVERRIDE_OLD = "I prefer a different style."
OVERRIDE_NEW = "Please prioritize the target requirements."
NO_CHOICE = "I don't have a preference for {}; please use your judgment."
NOTHING_MORE = "I don't have an additional preference for {}."
ANSWER = "For that, what matters is: {}."
NUDGE = "Those options are not quite right yet. Ask me about one specific attribute."
#: How a card names a colour and a price, and what an agent of weighted fields says.
CARD_COLOR, CARD_PRICE = "color: {}", "budget around ${}"
CLOSEST = "Here are the closest matches I found."
