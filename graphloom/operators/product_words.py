"""Word patterns that tell coffee from what else its shops sell, as regular expressions of whole words."""

# Title words and names of things that are never the product. Other lists can be given as configuration.
TITLE_NEVER = (
    "trash", "brewers?", "machine", "maker", "grinder", "kettle", "scale", "frother", "tamper", "portafilter", "carafe", "decanter", "jug", "dripper", "french\\s*press", "kit",
    "moccamaster", "technivorm", "chemex", "aeropress", "kalita", "hario", "fellow", "wilfa", "baratza", "comandante", "gooseneck", "breville", "gaggia", "rancilio", "profitec", "lelit", "rocket\\s*espresso", "v60",
    "mug", "tumbler", "tote", "hoodie", "t-?shirts?", "tees", "beanies?", "candle", "posters?", "stickers?", "kanteen", "bottle", "socks?",
    "sweat\\s?shirts?", "sweaters?(?!\\s+weather)", "jumpers?", "cardigans?", "crewnecks?", "keychains?", "key\\s?rings?", "enamel\\s+pins?", "saucers?", "reusable\\s+cups?", "insulated\\s+cups?", "onesies?", "art\\s+prints?",
    "sampler", "bundle", "gifts?", "sample\\s*set", "tasting\\s*set", "cleaning", "sets?",
    "pitcher", "tongs", "whisk", "brush", "funnel", "spoon", "towel", "apron", "magnet", "opener", "cambro", "glass\\s?ware", "shot\\s+glass", "measuring", "lids?", "sleeves?", "hot\\s+cups?", "cold\\s+cups?", "paper\\s+cups?", "tamp(?:ing)?\\s+mat", "drip\\s+mat",
    "rinza", "tablets?", "to-?go", "cap", "hat", "crewneck", "long\\s+sleeve", "trucker", "keep\\s?cup", "gift\\s+card", "e-?gift", "matcha", "cupping",
    "paper\\s+filters?", "filter\\s+baskets?", "filter\\s+papers?", "masking\\s+tape",
    "\\w*maskin\\w*", "\\w*kvern\\w*", "\\w*kanner?", "\\w*kopps?", "kaffefilter\\w*", "gavekort", "plakat\\w*", "n[øo]kkelring\\w*", "reservedel\\w*", "utstyr\\w*", "rengj[øo]r\\w*", "avkalk\\w*", "teposer", "l[øo]svekt-te", "mandler", "sjokolade\\w*",
    "la\\s*marzocco", "la\\s*pavoni", "acaia", "jura", "de.?longhi", "nuova\\s*simonelli", "mahlk[oö]nig", "fiorenzato", "macap", "appartamento", "gaskets?", "percolator\\w*", "dosing", "reservoir", "brewing\\s+system", "water\\s+filters?", "descal\\w*",
    "milk\\s+(?:system|container|pipe|cooler)", "cool\\s+control", "cafiza", "wdt", "bwt", "コーヒーメーカー",
    "מכונ\\w*", "מטחנ\\w*", "מקציף\\w*", "קומקום\\w*", "טבליות", "ידית\\w*", "סלסל\\w*", "ערכת", "כד", "בקבוק\\w*", "מעמד\\w*", "מכסה", "חולצ\\w*", "טבעת", "ניקוי", "הקצפה", "תרמוס",
    "פילטר\\s+מים", "פילטרים\\s+נייר", "ניירות\\s+פילטר", "כוס\\s+(?:מדידה|שקילה)", "משקל\\s+(?:קפה|למדידת)",
)
# Drinks that are not the product, and what makes them one after all.
BEVERAGE, BEVERAGE_UNLESS = ("chocolate", "horchata"), ("cold\\s*brew",)
# Categories that are never the product.
TYPE_NEVER = ("equipment", "gear", "accessor\\w*", "drinkware", "machine", "grinder", "brewers?", "merch\\w*", "apparel", "wearables?", "logoware", "vinyl", "records?", "albums?", "music", "cds?", "books?")
# Parts of a category that is the product.
TYPE_ALWAYS_TEXT = ("coffee", "コーヒー豆")
# Tags, categories and parts of categories that are not the product unless the category says it is.
TAG_NEVER = ("vinyl", "merch\\w*", "wearables?")
TYPE_UNLESS = ("tea", "brewing", "supplies", "warehouse", "event", "ticket", "subscription", "carbon\\s*offset", "alt\\s*beverage", "cleaning", "gifts?", "media", "kits?")
TYPE_UNLESS_TEXT = ("グッズ", "フード", "ギフト", "ドリンク", "ウェア")
