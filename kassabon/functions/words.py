"""Word lists and lookup tables that results depend on."""

# Letters with marks and the letters they fold to.
ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycn"

# Words that a canonical key leaves out.
KEY_STORES = "ah jumbo plus spar aldi dirk hema gwoon woon".split()
KEY_UNITS = "g gr gram ml cl dl kg l ltr liter lt st stuks stuk stks stk pak pakje pakken zak zakje fles flesje blik blikje pot potje bos bosje tray rol rolletje plak plakken plakjes doos set x per ca stuk(s)".split()
KEY_NOISE = "vers verse voordeel value aanbieding actie nieuw original origineel de het een van met en of voordeelverpakking grootverpakking".split()

# Words that a search leaves out.
SEARCH_STOP = """
    de het een van met en of in op voor aan per ca
    ah jumbo plus spar aldi dirk hema
    g gr gram ml cl dl kg st stuks stuk pak pakje zak fles blik pot liter stk
    vers verse biologisch bio naturel ongezouten gezouten light zero mild milde fijn fijne grof grove
    klein kleine groot grote mini jong jonge oud oude belegen volle halfvolle magere mager
    rood rode groen groene geel gele wit witte bruin bruine zoet zoete zuur zure
    gerookt gerookte gesneden geraspte gesnipperd gewassen voordeel original origineel heel hele
""".split()

# Endings that inflect a searched word.
ENDINGS = "s e n en er tje tjes je jes eren ren".split()

# Keys that mean the same product group.
KEY_SYNONYMS = {
    "cola": "coca_cola coca_cola_regular cola_original_taste cola_regular cola_regulier cola_regular_frisdrank pepsi_cola".split(),
    "cola_zero": "coca_cola_zero cola_zero_frisdrank cola_zero_sugar cola_zero_suiker".split(),
    "cola_kers": "cola_cherry cola_kers_frisdrank".split(),
    "cola_zero_kers": "cola_zero_cherry cola_zero_kers_frisdrank".split(),
    "cola_vanille": ["cola_vanilla"],
    "bloem": "tarwebloem patentbloem".split(),
    "paprika": "paprika_geel paprika_rood rode_paprika paprika_mix paprikamix paprika_duo".split(),
    "tomaat": "tomaten trostomaten trostomaat cherrytomaten".split(),
    "aardappel": "aardappelen aardappel_kruimig iets_kruimige_aardappelen vastkokende_aardappelen kruimige_aardappelen".split(),
    "ui": "uien gele_uien uien_geel".split(),
    "jonge_kaas": "goudse_kaas_jong goudse_kaas_jong_48_plus goudse_kaas_jong_48_plus_plakken goudse_kaas_mild".split(),
}
# Names that make a plain key a flavour (phrases stay together).
FLAVOURED = {
    "banaan": ("banaan_smaak", ["olvarit", "baby", "maaza", "yo to go", "yoghurt", "kwark", "drink", "drank", "milk", "melk", "smoothie", "pap", "knijpfruit", "danoontje", "alpro", "brinta", "muller", "müller", "breaker", "proteine", "proteïne", "ijs", "chips", "smaak"]),
    "paprika": ("paprika_smaak", "euroma essential paprikapoeder poeder kruiden chips heartbreakers pringles lays wokkels tuc doritos snack borrel saus spread roomkaas focaccia tortilla".split()),
}
# Names shown for keys.
DISPLAY = {
    "cola": "Cola", "cola_zero": "Cola zero", "cola_kers": "Cola kers", "cola_zero_kers": "Cola zero kers", "cola_vanille": "Cola vanille",
    "bloem": "Bloem", "banaan": "Banaan", "banaan_smaak": "Banaan smaak", "paprika": "Paprika", "paprika_smaak": "Paprika smaak",
    "tomaat": "Tomaat", "aardappel": "Aardappel", "ui": "Ui", "jonge_kaas": "Jonge kaas",
}
# What a query for a staple means.
STAPLES = {"melk": "halfvolle_melk", "yoghurt": "halfvolle_yoghurt", "rijst": "zilvervliesrijst", "koffie": "filterkoffie", "kaas": "jonge_kaas"}

# Quality flags of a product name, in the order of a signature.
VARIANTS = (
    ("organic", r"bio|biologisch|organic"),
    ("glutenfree", r"glutenvrij|gluten free"),
    ("lactosefree", r"lactosevrij|lactose free"),
    ("plantbased", r"vegan|vega|vegetarisch|plantaardig"),
    ("halal", r"halal"),
    ("alcoholfree", r"alcoholvrij|0\.0|0,0"),
    ("baby", r"baby|peuter|dreumes|zuigeling"),
    ("pet", r"hond|kat|katten|honden|huisdier"),
    ("diet", r"light|zero|suikervrij|minder suiker|dieet"),
)
# Brand words that a generic name leaves out.
BRANDS = "ah albert heijn jumbo aldi dirk plus spar huismerk basic biologisch bio".split()

# Units of recipes with the unit and factor they count as.
UNITS = {
    "g": ("g", 1), "gram": ("g", 1), "grams": ("g", 1), "kg": ("g", 1000), "kilogram": ("g", 1000),
    "ml": ("ml", 1), "milliliter": ("ml", 1), "l": ("ml", 1000), "liter": ("ml", 1000),
    "stuk": ("piece", 1), "stuks": ("piece", 1), "piece": ("piece", 1), "pieces": ("piece", 1), "teen": ("piece", 1), "tenen": ("piece", 1),
    "pak": ("pack", 1), "pakken": ("pack", 1), "package": ("pack", 1),
}

STORES = ("ah", "jumbo", "dirk", "plus", "spar", "aldi")
