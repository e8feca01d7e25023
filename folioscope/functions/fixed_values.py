"""Word lists, phrases and lookup tables that results depend on.

Everything here is data. Changing an entry changes answers, so the lists are kept
together and in their natural order.
"""

# --- money and numbers -------------------------------------------------------------------

RUPEES_PER_CRORE = 10_000_000
RUPEES_PER_LAKH = 100_000

NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60,
    "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
UNIT_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# --- dates -------------------------------------------------------------------------------

MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]

# --- places ------------------------------------------------------------------------------

STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat",
    "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab",
    "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh",
    "Uttarakhand", "West Bengal", "Delhi",
]

# Client names that arrive cut off in the source, with the full spelling.
CLIENT_CORRECTIONS = {
    "Irrigation & Waterways Dept, Govt of West": "Irrigation & Waterways Dept, Govt of West Bengal",
}

# --- words ignored when names are compared -------------------------------------------------

NAME_STOPWORDS = [
    "of", "the", "and", "&", "govt", "government", "department", "dept", "authority",
    "corporation", "office", "ltd", "limited", "co", "company",
]
# These do contribute a letter to an acronym although they are ignored in word overlap.
ACRONYM_LETTER_WORDS = ["authority", "corporation", "office"]

FUNCTION_WORDS = [
    "a", "an", "the", "of", "in", "on", "at", "by", "to", "up", "so", "as", "or", "and", "but",
    "nor", "for", "if", "no", "not", "am", "is", "are", "was", "were", "be", "been", "do",
    "does", "did", "has", "have", "had", "can", "may", "we", "us", "you", "he", "she", "it",
    "they", "them", "him", "her", "his", "its", "our", "me", "my",
]

# --- question wording ----------------------------------------------------------------------

ROLLUP_PHRASES = [
    "every completed", "all completed", "combined value", "total value", "aggregate value",
    "full rollup", "every assignment", "all assignments", "every project", "all projects",
    "every work", "all work", "every completed assignment", "combined total", "overall total",
    "all the completed", "across all", "across our", "across every", "full portfolio",
]
DIFFERENCE_PHRASES = [
    "difference between", "differ", "variance between", "variance", "gap between", "value diff",
    "rupee gap", "rupee difference", "shortfall", "how much more", "how much less",
    "exceed the second", "exceeds the second", "second-largest", "second largest", "movement",
    "spread",
]
SECOND_LARGEST_PHRASES = [
    "second-largest", "second largest", "exceed the second", "exceeds the second",
]
BILLING_PHRASES = [
    "outstanding", "shortfall", "awarded", "invoiced", "billed", "unpaid", "still due",
    "still owed", "collection", "received", "invoice",
]
DIRECTION_WORDS = ["threshold", "limit", "cutoff", "mark", "bar"]
GAP_WORDS = ["need", "secure"]

ABSENCE_WORDS = ["lack", "no client reference", "no reference letter", "unreferenced"]
ENDORSEMENT_WORDS = [
    "endorsement", "recommendation", "reference letter", "letters on file", "client letters",
    "endorse",
]
COLLECTION_WORDS = ["collection", "collected", "invoiced", "received", "billed"]
AFTER_PHRASES = [
    "completed after", "wrapped up after", "finished after", "reached completion after",
    "finished after that", "wrapped up after that", "post-certification",
]
AFTER_DATE_WORDS = ["2021", "march", "issuance", "date", "certification", "certified"]
EXCLUSION_PHRASES = [
    "excluding", "exclude", "remove the", "set aside", "setting aside", "filter out",
    "dropping the", "stripped out", "strip out", "without", "take out", "taking out",
    "leaving out", "leave out", "not counting", "minus the",
]
MEAN_WORDS = ["average", "mean", "avg"]
BALANCE_PHRASES = [
    "unpaid", "remaining balance", "remain unpaid", "still owe", "still due", "pending",
    "balance due", "net balance", "adjusted balance", "system balance", "credits are applied",
    "amount remains on the invoices", "balance when i cross-check", "balance still on our books",
    "balance still on their end", "cleared payments from our total billed",
    "deduct every cleared payment", "deducting all cleared payments",
]
CHARGE_WORDS = ["invoice", "bill", "charge"]
AWARD_WORDS = ["contract value", "awarded", "sanctioned"]
CATEGORY_TERMS = [
    "large bridges", "bridges flyovers", "bridges and flyovers", "bridges", "water treatment",
    "water supply", "tunnels", "industrial epc", "irrigation", "roads highways",
    "roads and highways", "roads maintenance", "maintenance", "roads", "small buildings",
    "buildings", "drainage", "sewerage drainage", "sewerage", "expressways",
]
SHORTFALL_PHRASES = [
    "gap between", "shortfall", "net difference", "amount after we cross-check", "delta between",
    "unbilled", "missing amount", "sitting above", "against the total contract value",
    "claims we submitted", "variance between",
]
SHORTFALL_OBJECTS = [
    "invoiced", "billed", "sanctioned", "actual gap", "submitted claims", "claimed", "cash flow",
    "commitments", "awards", "total value", "contract value", "invoice amount",
]
SHORTFALL_ALONE = [
    "unbilled remainder", "shortfall between", "gap between what they've sanctioned",
]
AVERAGE_SIZE_PHRASES = [
    "average size", "mean size", "overall average", "actual average", "mean volume",
    "mean scale", "proper baseline", "mean across all", "mean across", "mean contract value",
    "average contract value", "average across all", "typical scale", "typical project scale",
    "typical value",
]
LARGEST_WORDS = ["largest", "top finished", "highest-value", "biggest"]
RUNNER_UP_WORDS = [
    "second", "second-largest", "second-biggest", "next one down", "one just behind",
    "subsequent one", "next completed", "beats",
]
TARGET_GAP_PHRASES = [
    "additional work", "reach our credential target", "how much more contract value",
    "bring in to hit", "still need to secure", "need to clear the",
    "how much more value do we need",
]
BAR_PHRASES = [
    "threshold", "mark", "hitting", "at or over", "meet or exceed", "clear that mark",
    "clearing the", "or higher", "or more", "valued at", "crossing the", "limit",
]
BAR_UNIT_WORDS = [
    "crore", "cr", "lakh", "valued at", "mark", "threshold", "or more", "or higher",
    "at or over", "hitting",
]

# --- categories ----------------------------------------------------------------------------

CATEGORY_SYNONYMS = {
    "large bridges": "large bridges",
    "bridges and flyovers": "bridges flyovers",
    "bridges flyovers": "bridges flyovers",
    "bridges": "bridges flyovers",
    "water treatment": "water treatment",
    "water supply": "water supply",
    "sewerage drainage": "sewerage drainage",
    "sewerage": "sewerage drainage",
    "drainage": "sewerage drainage",
    "roads and highways": "roads highways",
    "roads highways": "roads highways",
    "roads maintenance": "roads maintenance",
    "maintenance": "roads maintenance",
    "roads": "roads highways",
    "expressways": "expressways",
    "tunnels": "tunnels",
    "industrial epc": "industrial epc",
    "epc": "industrial epc",
    "irrigation": "irrigation",
    "small buildings": "small buildings",
    "buildings": "buildings",
}
# An exclusion names a category the same way, except that bare "maintenance" is no synonym.
EXCLUSION_SYNONYMS = {k: v for k, v in CATEGORY_SYNONYMS.items() if k != "maintenance"}

# --- aliases, in the order they are tried ----------------------------------------------------

CLIENT_ALIASES = [
    ("up irrigation", "Irrigation & Waterways Dept, Govt of Uttar Pradesh"),
    ("uttar pradesh irrigation", "Irrigation & Waterways Dept, Govt of Uttar Pradesh"),
    ("west bengal irrigation", "Irrigation & Waterways Dept, Govt of West Bengal"),
    ("wb irrigation", "Irrigation & Waterways Dept, Govt of West Bengal"),
    ("rajasthan irrigation", "Irrigation & Waterways Dept, Govt of Rajasthan"),
    ("irr & waterways dept rajasthan", "Irrigation & Waterways Dept, Govt of Rajasthan"),
    ("maharashtra pwd", "Public Works Department, Govt of Maharashtra"),
    ("pwd maharashtra", "Public Works Department, Govt of Maharashtra"),
    ("mah pwd", "Public Works Department, Govt of Maharashtra"),
    ("gujarat pwd", "Public Works Department, Govt of Gujarat"),
    ("pwd gujarat", "Public Works Department, Govt of Gujarat"),
    ("gujarat pw", "Public Works Department, Govt of Gujarat"),
    ("tamil nadu pwd", "Public Works Department, Govt of Tamil Nadu"),
    ("west bengal pwd", "Public Works Department, Govt of West Bengal"),
    ("public works department", "Public Works Department, Govt of Maharashtra"),
    ("odisha phed", "Public Health Engineering Dept, Odisha"),
    ("phed odisha", "Public Health Engineering Dept, Odisha"),
    ("public health engineering dept odisha", "Public Health Engineering Dept, Odisha"),
    ("gujarat phed", "Public Health Engineering Dept, Gujarat"),
    ("phed gujarat", "Public Health Engineering Dept, Gujarat"),
    ("pheg gujarat", "Public Health Engineering Dept, Gujarat"),
    ("west bengal phed", "Public Health Engineering Dept, West Bengal"),
    ("public health engineering dept, west bengal", "Public Health Engineering Dept, West Bengal"),
    ("public health engineering dept west bengal", "Public Health Engineering Dept, West Bengal"),
    ("phed west bengal", "Public Health Engineering Dept, West Bengal"),
    ("jal nigam, jharkhand", "Jal Nigam, Jharkhand"),
    ("jharkhand jal nigam", "Jal Nigam, Jharkhand"),
    ("jal nigam, uttar pradesh", "Jal Nigam, Uttar Pradesh"),
    ("jal nigam uttar pradesh", "Jal Nigam, Uttar Pradesh"),
    ("up jal nigam", "Jal Nigam, Uttar Pradesh"),
    ("jal nigam up", "Jal Nigam, Uttar Pradesh"),
    ("jal nigam, gujarat", "Jal Nigam, Gujarat"),
    ("jal nigam in gujarat", "Jal Nigam, Gujarat"),
    ("jal nigam account in gujarat", "Jal Nigam, Gujarat"),
    ("gujarat jal nigam", "Jal Nigam, Gujarat"),
    ("jharkhand municipal", "Jharkhand Municipal Corporation"),
    ("maharashtra municipal", "Maharashtra Municipal Corporation"),
    ("gujarat municipal", "Gujarat Municipal Corporation"),
    ("tamil nadu municipal", "Tamil Nadu Municipal Corporation"),
    ("trishakti", "Trishakti Power Generation Corporation"),
    ("suvarna", "Suvarna Projects Limited"),
    ("mahanadi", "Mahanadi Steel Corporation"),
    ("lakshya", "Lakshya Engineering & Construction"),
    ("arunodaya", "Arunodaya Infrastructure"),
    ("meridian", "Meridian Constructors & Co."),
    ("peninsular", "Peninsular Petroleum Corporation"),
    ("subarnarekha", "Subarnarekha Valley Corporation"),
    ("mega infrastructure", "Mega Infrastructure Authority"),
    ("mega infra authority", "Mega Infrastructure Authority"),
    ("mega infra", "Mega Infrastructure Authority"),
    ("national expressway", "National Expressway Development Authority"),
    ("neda", "National Expressway Development Authority"),
    ("national special projects", "National Special Projects Office"),
    ("central works & buildings", "Central Works & Buildings Bureau"),
    ("central works", "Central Works & Buildings Bureau"),
    ("buildings bureau", "Central Works & Buildings Bureau"),
]

ENGINEER_ALIASES = [
    ("priti", "Priti Pillai"), ("pritis", "Priti Pillai"),
    ("neha", "Neha Chopra"), ("nehas", "Neha Chopra"),
    ("meera roy", "Meera Roy"), ("sanjay joshi", "Sanjay Joshi"),
    ("imran joshi", "Imran Joshi"), ("naveen roy", "Naveen Roy"),
    ("suresh desai", "Suresh Desai"), ("suresh das", "Suresh Das"),
    ("chandan banerjee", "Chandan Banerjee"), ("rahul menon", "Rahul Menon"),
    ("rahul das", "Rahul Das"), ("tanvir menon", "Tanvir Menon"),
    ("tanvir malhotra", "Tanvir Malhotra"), ("farhan rao", "Farhan Rao"),
    ("farhan khan", "Farhan Khan"), ("farhan roy", "Farhan Roy"),
    ("gautam joshi", "Gautam Joshi"), ("kavita reddy", "Kavita Reddy"),
    ("deepa chatterjee", "Deepa Chatterjee"), ("pooja bose", "Pooja Bose"),
    ("pooja sen", "Pooja Sen"), ("amit iyer", "Amit Iyer"), ("uma sen", "Uma Sen"),
    ("rohit singh", "Rohit Singh"), ("manoj verma", "Manoj Verma"),
    ("manoj kapoor", "Manoj Kapoor"),
]

# --- documents -------------------------------------------------------------------------------

COMPLETION_DOC_TYPES = ["completion_certificate", "company_completion_certificate"]
CREDENTIAL_SIX_SIGMA = "Six Sigma Black Belt"
CREDENTIAL_PMP = "PMP"
CREDENTIAL_OTHER = "Other"
