"""Values that decide results and therefore must stay exactly as they are."""

# --- fixed values: vocabularies ------------------------------------------------
CATEGORIES = ["tabac", "alcool", "cites", "viande", "contrefacon", "arme", "autre", "aucune"]
TARGET_CATEGORIES = ["tabac", "alcool", "cites", "viande", "contrefacon", "arme"]
NO_CATEGORY = "aucune"
DECISIONS = ["confirme", "rejete", "incertain"]
MODES = ["A", "B"]
RUN_STATUSES = ["running", "completed", "failed"]
EXTRACTOR_STATUSES = ["active", "pending", "rejected", "superseded"]
DIFFICULTIES = ["explicite", "implicite", "piege", "aucune"]

# --- fixed values: thresholds --------------------------------------------------
ALERT_THRESHOLD = 0.70
WATCH_THRESHOLD = 0.40
EVALUATION_THRESHOLD = 0.5
COHERENCE_LOW = 0.3
COHERENCE_HIGH = 0.5
BREAK_THRESHOLD = 0.5
RETRIEVAL_K = 3
RETRIEVAL_MIN_COSINE = 0.80
FOCUS_TERM_LIMIT = 10
DEPTH_STEPS = {"rapide": 8, "standard": 15, "approfondie": 25}
DEFAULT_DEPTH = "standard"
ACTION_BUDGET = 40

# --- fixed values: labels shown to investigators -------------------------------
CATEGORY_LABELS = {
    "tabac": "Tabac",
    "alcool": "Alcool",
    "cites": "CITES (espèces protégées)",
    "viande": "Viande",
    "contrefacon": "Contrefaçon",
    "arme": "Arme",
    "autre": "Autre (hors taxonomie)",
    "aucune": "Aucune",
}
DECISION_LABELS = {"confirme": "Confirmé", "rejete": "Écarté", "incertain": "À vérifier"}
NOT_REVIEWED_LABEL = "Non examiné"
ORIGIN_LABELS = {"A": "A · Surveillance", "B": "B · Exploration"}
UNKNOWN_LABEL = "—"
KIND_CODE = "figé (code)"
KIND_SELECTORS = "sélecteurs (réparable)"
KIND_NONE = "—"

# --- fixed values: keyword detector, tried in this order ----------------------
KEYWORDS = {
    "tabac": ["cigarette", "cigarettes", "tabac", "cartouche", "cartouches", "cigare", "cigares"],
    "alcool": ["alcool", "spiritueux", "gnole", "gnôle", "eau-de-vie", "whisky", "vodka", "absinthe", "vin"],
    "cites": ["ivoire", "corne", "écaille", "ecaille", "caviar", "tortue", "python", "corail"],
    "viande": ["viande", "foie gras", "jambon", "saucisse", "charcuterie"],
    "contrefacon": ["copie", "réplique", "replique", "contrefac", "faux", "imitation"],
    "arme": ["arme", "armes", "pistolet", "couteau", "munition", "matraque", "poignard", "revolver"],
}

# --- fixed values: text search --------------------------------------------------
SEARCH_WORD = "[a-z0-9àâäéèêëïîôöùûüç]+"
SEARCH_STOPWORDS = [
    "de", "des", "du", "la", "le", "les", "un", "une", "et", "ou", "en", "au",
    "aux", "pour", "par", "avec", "sans", "sur", "dans", "que", "qui", "ses",
    "der", "die", "das", "und", "mit", "für", "den", "dem",
]
SEARCH_MIN_TOKEN = 3

# --- fixed values: formats ------------------------------------------------------
STRICT_PRICE = r"(\d[\d'’.,\s]*)\s*([A-Za-z]{3})"
TOLERANT_PRICE = r"([\d'’.,]+)\s*([A-Za-z]{3})?"
DOWNLOAD_EXTENSIONS = [
    ".zip", ".rar", ".7z", ".tar", ".gz", ".exe", ".msi", ".dmg", ".apk",
    ".bin", ".iso", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]
REASON_DOMAIN = "hors allowlist: "
REASON_BLOCKLIST = "chemin interdit (blocklist)"
REASON_DOWNLOAD = "téléchargement interdit"
REASON_OK = "ok"
REQUIRED_FIELDS = ["title", "price", "description"]
CONTENT_FIELDS = ["description", "location", "price_amount", "price_currency", "seller", "title"]
SEALED_FIELDS = ["action", "actor", "created_at", "detail", "listing_id", "run_id"]
RULE_NAMESPACE = "6e3735b0-3ea8-5ec3-ab1c-feeb5689aa47"
BROWSE_ID_PREFIX = "browse:"
BROWSE_ACTOR = "LLM-BROWSE"
SCORE_ACTOR = "LLM-SCORE"
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
THIRD_PARTY_PROVIDER = "anthropic"
OPEN_PROVIDER = "openai"
OPEN_PROVIDER_HOST = "openai.com"

# --- fixed values: seed rows ----------------------------------------------------
PLATFORM_SEED = [
    ("ricardo", "https://www.ricardo.ch", 3, "A"),
    ("anibis", "https://www.anibis.ch", 2, "A"),
    ("tutti", "https://www.tutti.ch", 2, "A"),
    ("mock_shop", "http://mock_shop:8000", 1, "A"),
    ("facebook", "https://www.facebook.com/marketplace", 5, "B"),
    ("fake_market", "http://fake_market:8000", 1, "A"),
]
SELECTOR_SEED = {
    "title": "h1.listing-title",
    "price": ".listing-price",
    "seller": ".seller",
    "location": ".location",
    "description": ".listing-description",
}
SELECTOR_SEED_PLATFORM = "mock_shop"
PUBLIC_HOSTS = {"fake_market:8000": "localhost:8001", "mock_shop:8000": "localhost:8002"}

# --- fixed values: sentences of the run narrative -------------------------------
SENTENCE_SCORING = "L'analyse a produit {alerts} signal(aux) prioritaire(s) sur {scored} annonces analysées ({detail})."
SENTENCE_SCORING_NONE = "L'analyse a examiné {scored} annonces, sans signal prioritaire."
SENTENCE_COLLECTED = "La collecte a relevé {collected} annonces."
SENTENCE_SEARCH = "La recherche {target} et a généré {terms} termes de recherche."
SENTENCE_TARGET = "a ciblé la catégorie {categories}"
SENTENCE_NO_TARGET = "n'a ciblé aucune catégorie précise"
SENTENCE_ONE_SITE = "En exploration (Mode B), l'agent a parcouru librement le site désigné."
SENTENCE_MANY_SITES = "En exploration (Mode B), l'agent a parcouru librement les {sites} sites désignés."
SENTENCE_FOCUS = " La requête « {focus} » a orienté l'exploration et la priorisation des résultats."
SENTENCE_FOCUS_CATEGORIES = (
    " La requête « {focus} » (rattachée à : {categories}) a orienté l'exploration et la priorisation des résultats."
)
SENTENCE_FOCUS_TERMS = " LLM-EXPAND en a dérivé {terms} formulation(s) associée(s) pour guider l'agent."

# --- fixed values: prompt layout -------------------------------------------------
PROMPT_TITLE = "Titre : "
PROMPT_DESCRIPTION = "Description : "
PROMPT_PRICE = "Prix : "
PROMPT_PLACE = "Lieu : "
PROMPT_RULES = "Règles douanières potentiellement applicables (appuie-toi dessus si elles sont pertinentes) :"

# Scopes and fields of the default result and detail pages.
CARD_SCOPE = ".listing-card"
CARD_FIELDS = {
    "url": "a.listing-link@href",
    "title": ".listing-title",
    "price": ".listing-price",
    "platform": ".listing-platform",
}
DETAIL_SCOPE = ".listing-detail"
DETAIL_FIELDS = {
    "external_id": ".external-id",
    "title": ".title",
    "price": ".price",
    "platform": ".platform",
    "seller": ".seller",
    "location": ".location",
    "description": ".description",
}

# A field line of a rule file, and the fences around a model's answer.
RULE_FIELD_LINE = r"^-\s*\*\*(.+?)\*\*\s*:\s*(.*)$"
ANSWER_FENCE = r"(?md)^```(?:json)?|```$"
