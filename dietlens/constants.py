"""Rule tables and vocabularies. Results depend on them. Callers may pass their own."""

# Built-in lexicon of foods, herbs, drinks and supplements.
FOOD_LEXICON = [
    "grapefruit", "grapefruit juice", "orange juice", "cranberry", "cranberry juice", "apple juice",
    "pomelo", "seville orange", "fruit juice", "citrus juice",
    "alcohol", "alcoholic beverages", "wine", "beer", "ethanol", "coffee", "tea", "green tea",
    "food", "foods", "meal", "meals", "high-fat meal", "low-fat meal",
    "dairy", "dairy products", "milk", "yogurt", "cheese",
    "spinach", "broccoli", "kale", "leafy green vegetables", "leafy greens",
    "vitamin k rich foods", "vitamin k-rich foods",
    "st. john's wort", "ginseng", "ginkgo", "ginkgo biloba", "garlic", "ginger", "echinacea", "kava",
    "chamomile", "valerian", "licorice", "milk thistle", "saw palmetto", "black cohosh",
    "evening primrose oil",
    "potassium", "potassium rich foods", "salt", "sodium", "vitamin c", "vitamin d", "vitamin k",
    "iron", "calcium",
    "soy", "soy products", "soybean", "grapefruit products", "fiber", "dietary fiber",
    "enteral nutrition", "tube feeding",
]

# Terms too general to tell foods apart.
GENERIC_TERMS = [
    "food", "foods", "meal", "meals", "fruit", "fruits", "juice", "juices", "diet", "dietary",
    "alcohol", "alcoholic beverages",
]

# Words that open a list of foods.
ENUMERATION_MARKERS = ["such as", "including", "include", "includes", "examples include"]

# Severity patterns, most severe level first.
SEVERITY_PATTERNS = {
    "severe": [
        r"life[- ]?threatening", r"fatal", r"contraindicated", r"rhabdomyolysis",
        r"severe bleeding", r"major bleeding", r"hemorrhage", r"dangerous", r"avoid grapefruit",
    ],
    "moderate": [
        r"increase(s|d)? (the )?level", r"may increase", r"raise(s|d)?", r"reduce absorption",
        r"may decrease", r"dose adjustment", r"monitor",
    ],
    "minor": [
        r"take with food", r"food increases absorption", r"may cause stomach upset", r"nausea",
        r"drink plenty of fluids",
    ],
    "info": [r"no significant effect", r"minimal effect", r"not clinically important"],
}

# Severity labels from the mildest to the strongest.
SEVERITY_ORDER = ["info", "minor", "moderate", "severe"]

# Display marker of each severity label.
SEVERITY_MARKERS = {
    "severe": "🔴 شديدة",
    "moderate": "🟠 متوسطة",
    "minor": "🟡 بسيطة",
    "info": "🔵 معلوماتية فقط",
}
UNKNOWN_MARKER = "⚪ غير معروفة"

# Arabic word of each severity label.
SEVERITY_ARABIC = {
    "severe": "شديدة",
    "moderate": "متوسطة",
    "minor": "بسيطة",
    "info": "معلوماتية فقط",
}
UNKNOWN_ARABIC = "غير معروفة"

# Drugs always given by injection.
CURATED_INJECTABLES = [
    "alteplase", "reteplase", "tenecteplase", "urokinase", "streptokinase", "abciximab",
    "eptifibatide", "tirofiban", "heparin", "enoxaparin", "dalteparin", "fondaparinux",
    "darbepoetin alfa", "erythropoietin", "epoetin alfa", "peginterferon alfa-2a",
    "peginterferon alfa-2b", "interferon alfa-n1", "interferon alfa-n3", "interferon beta-1a",
    "interferon beta-1b", "interferon gamma-1b",
]

# Wording that points to an injection.
IV_TOKENS = [
    "intravenous", " iv ", "iv infusion", "infusion", "bolus", "injection", "inject",
    "subcutaneous", "intramuscular", "im injection", "sc injection",
]

# Wording that points to a drug taken by mouth.
ORAL_TOKENS = [
    "take with food", "take without regard to food", "take before meals", "take after meals",
    "take with or without food", "orally", "by mouth", "tablet", "capsule", "swallow",
    "food increases bioavailability", "food decreases bioavailability",
]

# Words of off-topic questions.
IRRELEVANT_WORDS = [
    "windows", "android", "iphone", "laptop", "computer", "pc", "playstation", "xbox", "television",
    "car", "engine", "router", "wifi", "internet", "server", "linux", "macos",
]

# Foods that thin the blood.
ANTICOAGULANT_FOODS = [
    "garlic", "ginger", "ginkgo", "ginkgo biloba", "ginseng", "bilberry", "danshen", "dong quai",
    "feverfew", "evening primrose", "turmeric", "curcumin", "clove", "anise", "red clover",
    "salicylate", "willow bark", "piracetam",
]

# Words behind each mechanism flag.
MECHANISM_WORDS = {
    "bleeding": ["bleeding", "hemorrhage", "anticoagulant", "antiplatelet"],
    "cyp3a4": ["grapefruit", "cyp3a4"],
    "vitamin_k": ["vitamin k", "leafy", "spinach"],
    "absorption": ["bioavailability", "absorption", "take with food"],
    "alcohol": ["alcohol", "ethanol"],
}

# Thresholds.
FOOD_SIMILARITY_THRESHOLD = 0.6
HIGH_CONFIDENCE = 0.7
MEDIUM_CONFIDENCE = 0.4
TEST_FRACTION = 0.2
SEED = 42
GENERAL_FOOD = "general food"
