"""Fixed values.

Every constant here must equal the product contract for results to match:
label lists, JSON field names, thresholds, output headings and file-name rules.
They are data, not logic, and are kept together so they can be checked by eye.
"""

# --- fixed label lists -------------------------------------------------------
CRITIC_KINDS = ["sayı", "isim", "tanım", "uyarı", "istisna", "adım"]
CRITIC_ORIGINS = ["ekran", "konuşma"]
ORIGIN_SCREEN = "ekran"
LEARNING_TYPES = ["tutorial", "kurs", "gelisim", "genel"]
CONTENT_TYPES = [
    "egitim", "sunum", "toplanti", "podcast", "soylesi", "gelisim", "haber", "genel",
]
DEFAULT_TYPE = "genel"
GENERIC_TITLES = ["", "playlist", "index", "master", "chunklist", "media", "video", "stream"]
MEDIA_SUFFIXES = ["m3u8", "mp4", "mkv", "webm", "mov", "m4a", "mp3", "wav", "ts"]
DIRECT_HOST = "b-cdn.net"
SOURCE_TEXT_LAYER = "metin-katmani"
SOURCE_OCR = "ocr"

# --- fixed alphabets ---------------------------------------------------------
TR_ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyzqwx"
VOWELS = "aeıioöuüAEIİOÖUÜ"
COMBINING_DOT = "̇"

# --- fixed thresholds --------------------------------------------------------
MIN_PUNCT = 1.0
MIN_CAPS = 0.15
MIN_REPAIR_WORDS = 0.6
OCR_CONF_MIN = 60.0
MIN_OCR_CHARS = 15
ROTATIONS = [0, 90, 180, 270]
MIN_TEXT_LAYER_CHARS = 40
MIN_WORD_RATIO = 0.50
MIN_RATIO_WORDS = 20
MIN_COMPRESSION_INPUT = 120
MIN_SECTION_SECONDS = 45.0
PART_SECONDS = 1800.0
PART_PAGES = 15
CHUNK_SECONDS = 600.0
MAX_PAGES = 600
MAX_FRAMES = 80
SAMPLE_INTERVAL = 5.0
SILENCE_DENSITY = 3
HASH_DISTANCE = 5
BLOCK_CHARS = 2500
SINGLE_BLOCK_CHARS = 3000
ONLINE_SECONDS = 90
SWEEP_SECONDS = 60
HISTORY_TURNS = 6
MAX_TITLE_SECTIONS = 40
MAX_TITLE_TOPICS = 25
MAX_TOPICS = 4
QUOTA_SHARE = 0.85
MIN_OUTPUT_TOKENS = 400
LINE_OVERHEAD = 12
BLOCK_SEPARATOR_CHARS = 2

# characters per request: provider -> (boundary, section, repair)
PROVIDER_WINDOWS = {
    "groq": (6_000, 8_000, 4_000),
    "openrouter": (120_000, 40_000, 10_000),
    "anthropic": (120_000, 40_000, 40_000),
    "gemini": (120_000, 40_000, 20_000),
}

# --- fixed output wording ----------------------------------------------------
INTRO_TITLE = "Giriş"
SPLIT_SUFFIX = "{k}. kısım"
WHOLE_SUFFIX = "Tüm hali"
TITLE_JOINT = " — "
PART_WORD = "Part"
UNASSIGNED = "atanmamis"
UNNAMED = "adsiz"
NOT_FOUND_ANSWER = "Bunu kaynakta bulamadım."
CROP_NOTICE = (
    "\n\n(Not: kaynak bu sohbet için çok uzundu, yalnızca ilk "
    "kısmına bakabildim — cevap eksik olabilir.)"
)
CROP_HEADER = " (yalnızca ilk kısmı — tümü sığmadı)"
HISTORY_HEADER = "ÖNCEKİ KONUŞMA (yalnızca soruyu anlamak için):\n"
NO_COLLECTIONS = "(henüz yok)"
NO_TOPICS = "(yok)"
SCREEN_BLOCK = "\n\n---\n\nEKRAN METNİ (OCR):\n\n"
REPAIR_SCREEN_BLOCK = "\n\n---\n\nEKRAN METNİ (terim ve özel isim düzeltmek için):\n\n"
DRAFT_BLOCK = "\n\n---\n\nTASLAK ÖZET:\n\n"
EMPTY_PART = "Bu parçada altyazı segmenti yok (boş aralık)."
UNREADABLE_PART = "Bu parçada okunabilir sayfa yok (taranmış/karantina)."
EMPTY_CAPTIONS = "Altyazı dosyası boş çözümlendi."
EMPTY_TRANSCRIPT = "Transkript boş döndü — ses kanalı sessiz olabilir."
DETAIL_HEADING = "## Detaylı Özet"
