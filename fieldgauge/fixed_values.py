"""Fixed values.

Word lists, lookup tables and thresholds that have to be exactly these for
results to be right. They are plain data; all logic lives in the operators.
Larger taxonomies (industry labels, label vectors) are never listed here: they
enter every operator as a table.
"""

# --- fixed values: places -------------------------------------------------
# (postal code, FIPS code or None, name); FIPS exists for the 50 states + DC.
STATES = (
    ("AL", "01", "Alabama"), ("AK", "02", "Alaska"), ("AZ", "04", "Arizona"),
    ("AR", "05", "Arkansas"), ("CA", "06", "California"), ("CO", "08", "Colorado"),
    ("CT", "09", "Connecticut"), ("DE", "10", "Delaware"),
    ("DC", "11", "District of Columbia"), ("FL", "12", "Florida"),
    ("GA", "13", "Georgia"), ("HI", "15", "Hawaii"), ("ID", "16", "Idaho"),
    ("IL", "17", "Illinois"), ("IN", "18", "Indiana"), ("IA", "19", "Iowa"),
    ("KS", "20", "Kansas"), ("KY", "21", "Kentucky"), ("LA", "22", "Louisiana"),
    ("ME", "23", "Maine"), ("MD", "24", "Maryland"), ("MA", "25", "Massachusetts"),
    ("MI", "26", "Michigan"), ("MN", "27", "Minnesota"), ("MS", "28", "Mississippi"),
    ("MO", "29", "Missouri"), ("MT", "30", "Montana"), ("NE", "31", "Nebraska"),
    ("NV", "32", "Nevada"), ("NH", "33", "New Hampshire"), ("NJ", "34", "New Jersey"),
    ("NM", "35", "New Mexico"), ("NY", "36", "New York"),
    ("NC", "37", "North Carolina"), ("ND", "38", "North Dakota"), ("OH", "39", "Ohio"),
    ("OK", "40", "Oklahoma"), ("OR", "41", "Oregon"), ("PA", "42", "Pennsylvania"),
    ("RI", "44", "Rhode Island"), ("SC", "45", "South Carolina"),
    ("SD", "46", "South Dakota"), ("TN", "47", "Tennessee"), ("TX", "48", "Texas"),
    ("UT", "49", "Utah"), ("VT", "50", "Vermont"), ("VA", "51", "Virginia"),
    ("WA", "53", "Washington"), ("WV", "54", "West Virginia"),
    ("WI", "55", "Wisconsin"), ("WY", "56", "Wyoming"),
    ("PR", None, "Puerto Rico"), ("GU", None, "Guam"),
    ("VI", None, "U.S. Virgin Islands"), ("AS", None, "American Samoa"),
    ("MP", None, "Northern Mariana Islands"),
)

TERRITORIES = ("Puerto Rico", "American Samoa", "Guam", "Northern Mariana Islands")

STATE_TYPOS = {
    "Flrida": "Florida", "Flordia": "Florida", "Californie": "California",
    "Califrnia": "California", "Calfornia": "California", "Califonia": "California",
    "Georgea": "Georgia", "Tennesse": "Tennessee", "Pennsylvnia": "Pennsylvania",
    "Pennsylvannia": "Pennsylvania", "Washignton": "Washington",
    "Massacusetts": "Massachusetts", "Massachsetts": "Massachusetts",
    "Massachusets": "Massachusetts", "Connecticutt": "Connecticut",
    "Louisianna": "Louisiana", "Missisipi": "Mississippi",
    "Missisippi": "Mississippi", "Minnessota": "Minnesota",
}

# second word of a split place name -> (first word expected in city, state,
# full city name or None where the pair is not a city)
SPLIT_PLACES = {
    "York": ("New", "New York", "New York"),
    "Hampshire": ("New", "New Hampshire", None),
    "Jersey": ("New", "New Jersey", None),
    "Mexico": ("New", "New Mexico", None),
    "Orleans": ("New", "Louisiana", "New Orleans"),
    "Angeles": ("Los", "California", "Los Angeles"),
    "Francisco": ("San", "California", "San Francisco"),
    "Diego": ("San", "California", "San Diego"),
    "Antonio": ("San", "Texas", "San Antonio"),
    "Jose": ("San", "California", "San Jose"),
    "Vegas": ("Las", "Nevada", "Las Vegas"),
    "Paso": ("El", "Texas", "El Paso"),
}

# place words seen in the state column that are certainly outside the country,
# and empty-like words; used only to name a category of invalid value
FOREIGN_PLACES = ("Ontario", "London", "Maharashtra", "Karnataka", "Delhi", "Gauteng", "Dubai")
JUNK_STATES = ("Null", "Unknown")

JUNK_CITIES = (
    "ny", "fl", "dc", "la", "sf", "mc", "n/a", "na", "none", "null", "unknown",
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "ga", "hi", "id", "il", "in",
    "ia", "ks", "ky", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv",
    "nh", "nj", "nm", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn",
    "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy",
)

# --- fixed values: names and web addresses --------------------------------
NAME_SENTINELS = (
    "closed", "none", "n/a", "na", "null", "unknown", "retired", "test",
    "deleted", "delete", "removed", ".", "-", "...", "x", "a",
)

PLACEHOLDER_URLS = (
    "www", "http", "https", "http://", "https://", "www.", "http://www",
    "https://www", "http://www.", "https://www.", "com", ".com", "n/a", "none",
    "null", "na", "n.a.", "-", "example.com", "test.com", "website.com",
)

PLATFORM_DOMAINS = (
    "yelp.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com",
    "linktr.ee", "bit.ly", "hub.biz", "wixsite.com", "weebly.com",
    "wordpress.com", "squarespace.com", "google.com", "amazon.com", "youtube.com",
)

INSTITUTIONAL_TLDS = ("edu", "gov", "mil")

# classes of address beyond the core platform list
URL_CLASSES = (
    ("site_builder", ("webs.com", "wix.com", "godaddysites.com", "webflow.io",
                      "carrd.co", "homestead.com", "tripod.com")),
    ("business_profile", ("business.site",)),
    ("shop_platform", ("etsy.com", "myshopify.com", "square.site")),
    ("content_platform", ("medium.com", "substack.com", "vimeo.com", "tumblr.com",
                          "spotify.com", "buzzsprout.com")),
    ("community_platform", ("meetup.com", "wildapricot.org", "thetopperson.com")),
    ("directory", ("bbb.org",)),
    ("shortener", ("tinyurl.com",)),
    ("email_as_url", ("gmail.com",)),
)
PARENT_BRAND_DOMAINS = ("marriott.com", "hilton.com", "hyatt.com", "apple.com",
                        "expresspros.com", "ajg.com")

NAME_DOMAIN_STOP_WORDS = (
    "the", "and", "inc", "llc", "ltd", "corp", "co", "company", "group", "of",
    "for", "in", "at", "by", "de", "la", "el",
)

# --- fixed values: enumerations -------------------------------------------
SIZE_BANDS = ("1-10", "11-50", "51-200", "201-500", "501-1K", "1K-5K", "5K-10K", "10K+")
ENTITY_TYPES = (
    "Privately Held", "Self-Owned", "Nonprofit", "Partnership", "Public Company",
    "Self-Employed", "Educational", "Government Agency",
)
SEGMENT_OF_BAND = {
    "1-10": "micro", "11-50": "smb", "51-200": "mid_market", "201-500": "mid_market",
    "501-1K": "enterprise", "1K-5K": "enterprise", "5K-10K": "enterprise",
    "10K+": "enterprise",
}

SECTORS = {
    "11": "Agriculture, Forestry, Fishing and Hunting",
    "21": "Mining, Quarrying, and Oil and Gas Extraction",
    "22": "Utilities",
    "23": "Construction",
    "31-33": "Manufacturing",
    "42": "Wholesale Trade",
    "44-45": "Retail Trade",
    "48-49": "Transportation and Warehousing",
    "51": "Information",
    "52": "Finance and Insurance",
    "53": "Real Estate and Rental and Leasing",
    "54": "Professional, Scientific, and Technical Services",
    "55": "Management of Companies and Enterprises",
    "56": "Administrative and Support and Waste Management",
    "61": "Educational Services",
    "62": "Health Care and Social Assistance",
    "71": "Arts, Entertainment, and Recreation",
    "72": "Accommodation and Food Services",
    "81": "Other Services (except Public Administration)",
    "99": "Industries not classified",
}
# sectors that have no non-employer counterpart, and those dominated by sole operators
NO_NONEMPLOYER_SECTORS = ("55", "99")
GIG_SECTORS = ("48-49", "81", "56", "53")

SECTOR_AUDIENCE = {
    "B2B": (11, 21, 22, 23, 31, 32, 33, 42, 48, 49, 51, 52, 53, 54, 55, 56, 92),
    "B2C": (44, 45, 61, 71, 72),
    "Both": (62, 81),
}

# (pattern, type, confidence, is the entity confirmed); first match wins
NAME_TYPE_PATTERNS = (
    (r"(?i)\bCity of\b", "Government Agency", 0.93, True),
    (r"(?i)\bSchool District\b", "Educational", 0.91, True),
    (r"(?i)\bCounty of\b", "Government Agency", 0.88, True),
    (r"(?i)\bFoundation\b", "Nonprofit", 0.92, True),
    (r"(?i)\b(?:Church|Ministry|Ministries)\b", "Nonprofit", 0.88, True),
    (r"(?i)\b(?:Fire Department|Fire Dept|Police Department)\b", "Government Agency", 0.82, True),
    (r"\bLLP\b", "Partnership", 0.76, True),
    (r"\b(?:ISD|USD|CUSD)\b", "Educational", 0.79, True),
    (r"(?i)\bInc\.?\b", "Privately Held", 0.73, False),
    (r"(?i)\bCorp\.?\b", "Privately Held", 0.72, False),
    (r"(?i)\b(?:University|College)\b", "Educational", 0.65, False),
    (r"(?i)\bTownship\b", "Government Agency", 0.63, False),
)
K12_HOST = r"\.k12\.[a-z]{2}\.us$"
FOREIGN_GOV_HOST = r"\.gov\.[a-z]{2}$"

# label pairs that mean the same; the first of each pair is canonical
DUPLICATE_LABELS = (
    ("it services and it consulting", "information technology & services"),
    ("wellness and fitness services", "health, wellness & fitness"),
    ("non-profit organizations", "non-profit organization management"),
)

PUBLIC_SECTOR_LABELS = (
    "higher education", "government administration",
    "primary and secondary education", "law enforcement",
    "education administration programs",
)

LABEL_STOP_WORDS = ("and", "or", "of", "the", "a", "an", "in", "for", "to", "with",
                    "by", "at", "on", "its", "as", "from", "&")

# ordered keyword rules: any shared word picks the label, the first rule wins
KEYWORD_LABELS = (
    (("hospital", "hospitals"), "hospitals and health care"),
    (("restaurant", "restaurants", "dining", "eatery"), "restaurants"),
    (("maritime", "shipping", "tanker", "bulk", "liquid"), "maritime transportation"),
    (("law", "attorney", "attorneys", "lawyers", "litigation", "llp", "p.a."), "law practice"),
    (("legal",), "legal services"),
    (("district", "isd", "k-12", "k12", "elementary", "secondary"), "primary and secondary education"),
    (("school",), "primary and secondary education"),
    (("vehicle", "auto", "automobile", "body", "repair"), "vehicle repair and maintenance"),
    (("defense", "missile", "munitions"), "defense and space manufacturing"),
    (("aerospace", "space", "satellite", "rocket", "launch"), "aviation and aerospace component manufacturing"),
    (("skincare", "beauty", "cosmetics", "personal", "care"), "personal care product manufacturing"),
    (("staffing", "recruiting", "temp", "placement"), "staffing and recruiting"),
    (("trucking", "truck", "freight", "hauling"), "truck transportation"),
    (("it", "software", "saas", "app", "platform", "cloud", "tech"), "it services and it consulting"),
    (("consulting", "advisory", "management", "strategy"), "business consulting and services"),
    (("real", "estate", "realty", "property", "brokerage"), "real estate"),
    (("warehouse", "warehousing", "storage", "fulfillment"), "warehousing and storage"),
    (("construction", "contractor", "building"), "construction"),
    (("healthcare", "health", "medical", "clinical"), "hospitals and health care"),
    (("education", "university", "college", "higher"), "higher education"),
    (("nonprofit", "non-profit", "charity", "foundation"), "philanthropic fundraising services"),
    (("government", "agency", "federal", "municipal"), "government administration"),
    (("public", "safety", "corrections", "prison"), "public safety"),
    (("outsourcing", "bpo", "offshoring"), "outsourcing and offshoring consulting"),
    (("insurance",), "insurance"),
    (("banking", "bank", "financial"), "banking"),
    (("retail",), "retail"),
    (("hospitality", "hotel", "lodging"), "hospitality"),
    (("manufacturing",), "manufacturing"),
    (("logistics", "supply", "chain", "distribution"), "transportation, logistics, supply chain and storage"),
    (("telecom", "telecommunications", "wireless"), "telecommunications"),
    (("defense", "military"), "defense and space manufacturing"),
)

# words that mark a placeholder company name
PLACEHOLDER_NAME = r"(?i)\b(stealth|startup|placeholder|unknown|confidential)\b"
