"""Values that results depend on. Fixed: word lists, classes of characters, weights and limits."""

ZWNJ = "‌"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"

#: Characters of a token; the second class joins words over a half-space.
TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
LEXICAL_TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}\x{200C}]+"

#: Words without content of their own, for ranking and (with changes) for evidence.
_SHARED_STOPWORDS = (
    "و در از به که این آن را با برای تا یا هم اگر یک ها های است هست بود شد می نمی شود کنیم "
    "چه چیست چگونه کدام چرا آیا کی کجا the a an is are of to in for and or on"
)
RANKING_STOPWORDS = [*_SHARED_STOPWORDS.split(), "شودد", "شودید"]
EVIDENCE_STOPWORDS = [*_SHARED_STOPWORDS.split(), "کند", "کنید"]
KEYWORD_STOPWORDS = "است هست می‌شود شود برای این آن که از در به با یا و تا یک را".split()

#: Senses asked for, and senses that mislead.
RANKING_DISTRACTORS = [
    ("اولیه اوليه پیشفرض پيشفرض", "فراموشی فراموش ریست بازیابی"),
    ("ورود وارد", "خروج فراموشی ریست"),
    ("نام کاربری شناسه", "فراموشی ریست رمز"),
]
EVIDENCE_DISTRACTORS = [
    ("اولیه اوليه پیشفرض پيشفرض", "فراموشی فراموش ریست بازیابی"),
    ("ورود وارد", "خروج فراموشی ریست"),
    ("نام کاربری شناسه", "فراموشی ریست"),
    ("پیشنیاز پیش‌نیاز پيشنياز", "همنیاز هم‌نیاز همنياز"),
    ("همنیاز هم‌نیاز همنياز", "پیشنیاز پیش‌نیاز پيشنياز"),
    ("اضطراری اضطراري", "اضافه حذف‌واضافه حذفواضافه"),
]

BM25_K1, BM25_B, RRF_K = 1.5, 0.75, 60
POOL, FUSED = 30, 24
COSINE_WEIGHT, RRF_WEIGHT = 0.72, 0.28

#: Calibration of ranking.
MAX_BONUS, MAX_PENALTY = 0.18, 0.10
W_FAQ, W_HEADING, W_PHRASE, W_BODY = 0.12, 0.06, 0.10, 0.06
W_GENERIC, W_DISTRACTOR = 0.05, 0.06

#: Weights of the signals of evidence, thresholds and caps.
EVIDENCE_WEIGHTS = {
    "lexical_overlap": 0.14, "persian_keyword_overlap": 0.12, "heading_similarity": 0.10, "faq_question_similarity": 0.16,
    "exact_phrase": 0.12, "numeric_agreement": 0.08, "named_entities": 0.06, "section_proximity": 0.05,
    "rc32_ranking_score": 0.10, "hybrid_rank_score": 0.07,
}
PRIMARY_AT, SUPPLEMENTARY_AT, FLOOR, EVIDENCE_PENALTY = 0.42, 0.28, 0.18, 0.12
MAX_PRIMARY, MAX_SUPPLEMENTARY = 3, 2

#: Browsers, course codes and numbers that boost lexical hits.
BROWSER = r"(?i)\b(google\s*chrome|chrome|firefox|mozilla|edge|safari)\b"
COURSE_CODE = r"\b(?:گزارش\s*)?\d{1,3}\b"
NUMBER = r"\d+(?:[./-]\d+)*"

#: Context, prompt and sufficiency.
CONTAINMENT, TOKEN_JACCARD = 0.85, 0.92
PROMPT_CHARS, BLOCK_CHARS, EXCERPT_CHARS, MIN_EVIDENCE = 24_000, 1_600, 240, 0.25
