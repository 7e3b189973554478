"""Fixed values that decide results: label sets, word lists, patterns, thresholds.

Everything in this file is data. The order of every list is its natural order and is part of
the contract (labels index probability vectors, weak-label lists are scanned left to right).
"""

from __future__ import annotations

# --- labels (fixed values) --------------------------------------------------
LABELS = ("positive", "negative", "neutral", "positive_sarcasm", "negative_sarcasm")
SARCASM_LABELS = ("positive_sarcasm", "negative_sarcasm")
REQUIRED_FIELDS = ("post_id", "caption", "image_path", "label", "annotators")
LABEL_DISPLAY = {
    "positive": "مثبت",
    "negative": "منفی",
    "neutral": "خنثی",
    "positive_sarcasm": "کنایه مثبت",
    "negative_sarcasm": "کنایه منفی",
}

# --- discrepancy features (fixed values) ------------------------------------
FEATURE_NAMES = ("Dsem", "Dsen", "Fvt", "cos_TI", "polarity_T", "polarity_T_hat")
CORE_SIGNALS = ("Dsem", "Dsen", "Fvt")
AUX_SIGNALS = ("cos_TI", "polarity_T", "polarity_T_hat")
DISCREPANCY_SIGNALS = ("Dsem", "Dsen", "Fvt", "cos_TI")
FVT_THRESHOLD = 0.2
VECTOR_ROW_FIELDS = ("post_id", "label", "image_emb", "text_emb", "T_hat_emb", "discrepancy_vec")

# --- text normalisation (fixed values) --------------------------------------
ARABIC_FORMS_FROM = "يكىٱأإ"
ARABIC_FORMS_TO = "یکیااا"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
MIN_SCRIPT_RATIO = 0.5

# --- spam captions (fixed values) -------------------------------------------
SPAM_SUBSTRINGS_FA = (
    "هوش مصنوعی",
    "هوش_مصنوعی",
    "پرامپت",
    "پرامپ",
    "تصویر مرجع",
    "واترمارک",
    "آپلود کنید",
    "دستورالعمل",
    "کامنت کن",
    "کامنت‌کن",
    "دایرکت",
    "فالو کن",
    "فالوم کن",
    "لایک کن",
    "ربات نمیتونه",
    "ربات نمیتواند",
    "برای دریافت پرامپت",
    "سلبریتی ها عکس",
    "عکس سلبریتی",
    "با سلبریتی",
    "پیام بده",
    "کلمه «",
    'کلمه "',
    "وارد  gemini",
    "چت جی پی تی",
    "چت_جی_پی_تی",
)
SPAM_SUBSTRINGS_LATIN = (
    "prompt",
    "gemini",
    "chatgpt",
    "chat gpt",
    "midjourney",
    "openai",
    "#aiart",
    "ai art",
)
SPAM_LONG_TEXT = 450
SPAM_LONG_WORDS = ("پنل", "نورپردازی", "زاویه دید", "ایربراش")

# --- sarcasm cues (fixed values, searched in case-folded text with single spaces) ---
NEG_WORDS = (
    "ناراحت",
    "غمگین",
    "غم",
    "گریه",
    "افسرد",
    "حالم بد",
    "حالمبد",
    "خسته",
    "عصبانی",
    "نفرت",
    "بدبخت",
    " miserable",
    "sad",
    "depressed",
    "tired",
    "hate",
    "upset",
)
POS_WORDS = (
    "خوشحال",
    "شاد",
    "عالی",
    "فوق العاده",
    "فوقالعاده",
    "love",
    "happy",
    "great",
    "amazing",
    "best day",
    "bestday",
)
CONTRAST_WORDS = ("ولی", "اما", "در حالی", "although", "but ")
RHETORICAL_WORDS = ("ببینم", "کی بلد", "مگه", " seriously", "yeah right")
IRONY_WORDS = ("کنایه", "طنز", "سرتق", "irony", "ironic", "sarcasm")
HAPPY_EMOJI = r"[\x{1F600}-\x{1F64F}\x{2764}\x{1F970}\x{1F60A}\x{1F602}]"
SAD_EMOJI = r"[\x{1F622}-\x{1F62D}\x{1F614}\x{1F61E}\x{2639}]"
SARCASM_MIN_LENGTH = 8

# --- the same cues as patterns, for the SQL twins (fixed values) ------------
NEG_PATTERN = r"ناراحت|غمگین|غم|گریه|افسرد|حالم\s*بد|خسته|عصبانی|نفرت|بدبخت| miserable|sad|depressed|tired|hate|upset"
POS_PATTERN = r"خوشحال|شاد|عالی|فوق\s*العاده|love|happy|great|amazing|best\s*day"
TURN_PATTERN = r"ولی|اما|در\s+حالی|although|but\s+|ببینم|کی\s+بلد|مگه| seriously|yeah\s+right"
IRONY_PATTERN = r"کنایه|طنز|سرتق|iron(y|ic)|sarcasm"

# --- weak labels (fixed values) ---------------------------------------------
WEAK_POSITIVE_WORDS = ("خوشح", "عالی", "زیب", "دوست", "شاد", "❤", "🥰", "😍", "ممنون", "love")
WEAK_NEGATIVE_WORDS = ("ناراح", "غم", "بد", "عصب", "اشک", " hate", "angry", "sad")
WEAK_POSITIVE_NAMES = ("DELIGHT", "HAPPY", "POSITIVE")
WEAK_NEGATIVE_NAMES = ("SAD", "ANGRY", "NEGATIVE")
WEAK_NEUTRAL_NAMES = ("NEUTRAL",)
WEAK_NEGATIVE_PARTS = ("NEG", "ANGR", "SAD")
POLARITY_POS_NAMES = ("HAPPY", "POSITIVE", "POS", "GOOD", "LOVE", "POS_LABEL")
POLARITY_NEG_NAMES = ("SAD", "NEGATIVE", "NEG", "BAD", "ANGRY", "NEG_LABEL")
WEAK_KEYWORD_ANNOTATOR = "weak_keywords"
WEAK_MODEL_ANNOTATOR = "weak_parsbert"
WEAK_SARCASM_ANNOTATOR = "weak-sarcasm-bootstrap"
UNKNOWN_ANNOTATOR = "_unknown_"

# --- agreement report (fixed values) ----------------------------------------
REPORT_TITLE = ("# Inter-Annotator Agreement", "", "## Per-pair Cohen's kappa", "")
REPORT_NO_PAIRS = "_No overlapping samples between annotators yet._"
REPORT_PAIRS_HEAD = ("| Annotator A | Annotator B | Overlap | Kappa |", "| --- | --- | --- | --- |")
REPORT_COUNTS_HEAD = ("", "## Per-annotator counts", "", "| Annotator | Labeled posts |", "| --- | --- |")

# --- page and link patterns (fixed values) ----------------------------------
SHORTCODE_PATTERN = r"(?:instagram\.com/(?:p|reel|tv)/|/p/)([A-Za-z0-9_-]{5,})"
BARE_SHORTCODE_PATTERN = r"^[A-Za-z0-9_-]{5,}$"
LINK_KIND_PATTERN = r"/(p|reel|tv)/[A-Za-z0-9_-]+"
EMBED_URL_TEMPLATE = "https://www.instagram.com/%s/%s/embed/captioned/"
POST_URL_TEMPLATE = "https://www.instagram.com/%s/%s/"
MEDIA_URL_PATTERN = r"(?i)https://[^\"'\s]*scontent[^\"'\s]+\.(?:jpg|webp)[^\"'\s]*"
THUMBNAIL_MARKERS = ("s100x100", "s150x150", "/t51.82787-19/")
MEDIA_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
MEDIA_MIME_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp")
SEARCH_MARKERS = "?*~"
# Where page data keeps a caption, and the length a text must exceed to count as one (fixed values).
CAPTION_PATHS = (
    (("edge_media_to_caption", "edges", 0, "node", "text"), 0),
    (("caption", "text"), 3),
)
CAPTION_TYPES = ("Caption", "Comment")
TYPED_CAPTION_OVER = 8

# --- prediction rules (fixed values) ----------------------------------------
CONFLICT_TEXT_BAND = 0.05
CONFLICT_HAT_BAND = 0.15
CONFLICT_MIN_DSEN = 0.35
CONFLICT_BOOST = 0.15
CONFLICT_BOOST_CAP = 0.85
CONFLICT_FLOOR = 0.35
CONFIDENCE_CAP = 0.99
POLARITY_PHRASE_BAND = 0.15

# --- evaluation (fixed values) ----------------------------------------------
N_FOLDS = 5
THRESHOLD_START = 0.25
THRESHOLD_STOP = 0.65
THRESHOLD_STEPS = 81
DEFAULT_DSEM_THRESHOLD = 0.45
SARCASM_ACCURACY_FLOOR = 0.70
SARCASM_F1_DELTA_FLOOR = 0.10
LOGREG_F1_FLOOR = 0.40
ONE_GIB = 1024**3

# --- token display (fixed values) -------------------------------------------
ANCHOR_TOKENS = (
    "[CLS]",
    "[SEP]",
    "[PAD]",
    "[UNK]",
    "<s>",
    "</s>",
    "<pad>",
    "<unk>",
    "<|endoftext|>",
)
CONTINUATION_PREFIX = "##"
SENTENCEPIECE_PREFIX = "▁"
ATTACH_CHARS = "!.,;:?؟،٪٫…"
