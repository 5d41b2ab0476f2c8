"""Closed tables: languages, dimensions, scripts, function words, weight vectors, baselines and answer letters."""

from __future__ import annotations

# Language codes in order, and the catalogue name of each one's web corpus and of its benchmarks.
LANGUAGES = {"vi": "vie_Latn", "id": "ind_Latn", "th": "tha_Thai", "km": "khm_Khmr", "ms": "zsm_Latn", "tl": "fil_Latn", "my": "mya_Mymr", "lo": "lao_Laoo"}
BENCHMARK_CONFIGS = {**LANGUAGES, "tl": "tgl_Latn"}

# Quality dimensions, in order.
DIMENSIONS = ("educational_value", "reasoning", "professionalism", "cleanliness", "cultural_nuance")

# Code points of each language's script. The languages of the test tables (en, de, es, fr) are Latin.
SCRIPT_RANGES = {
    "vi": ((0x0041, 0x024F), (0x1E00, 0x1EFF)), "id": ((0x0041, 0x024F),), "th": ((0x0E00, 0x0E7F),), "km": ((0x1780, 0x17FF),),
    "ms": ((0x0041, 0x024F),), "tl": ((0x0041, 0x024F),), "my": ((0x1000, 0x109F),), "lo": ((0x0E80, 0x0EFF),),
    "en": ((0x0041, 0x024F),), "de": ((0x0041, 0x024F),), "es": ((0x0041, 0x024F),), "fr": ((0x0041, 0x024F),),
}
LATIN = ((0x0000, 0x024F), (0x1E00, 0x1EFF))

# Function words of each language; en, de, es and fr are for the test tables.
STOPWORDS = {
    "vi": "và của là có trong được cho một này với đã các để không những khi đến như về từ người cũng sẽ đó ra nên còn vì nếu rằng".split(),
    "id": "yang dan di itu dengan untuk tidak ini dari dalam akan adalah pada juga ke karena ada atau saya kita mereka bisa sudah saat oleh para namun seperti jika harus".split(),
    "th": "และ ที่ ใน การ เป็น ของ มี ได้ ไม่ ให้ จะ ก็ แต่ หรือ กับ นี้ ว่า จาก เพื่อ ต้อง".split(),
    "km": "និង នៃ គឺ នេះ ជា បាន ដែល នៅ ក្នុង ចំពោះ ដើម្បី ពី ទៅ មាន ត្រូវ ដោយ ឬ ប៉ុន្តែ ដូច ថា".split(),
    "ms": "yang dan di itu dengan untuk tidak ini dari dalam akan adalah pada juga ke kerana ada atau saya kita mereka boleh sudah oleh para namun seperti jika mesti".split(),
    "tl": "ang ng sa na at ay mga ito may hindi kung para dahil siya ako kami tayo sila din rin pa po wala naman lang".split(),
    "my": "နှင့် သည် များ တွင် ဖြစ် ရှိ မှ အတွက် လည်း ကို နဲ့ ပါ".split(),
    "lo": "ແລະ ແມ່ນ ຂອງ ໃນ ມີ ໄດ້ ບໍ່ ໃຫ້ ກັບ ນີ້ ວ່າ ຈາກ ຈະ ກໍ".split(),
    "en": "the of and to in a is that it for on with as was at by this are be from".split(),
    "de": "der die das und in zu den mit von ist für auf ein eine nicht als auch es sich dem".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus avec".split(),
}
#: Languages whose words white space parts; in the others function words are counted as substrings.
SEGMENTED = ("vi", "id", "ms", "tl", "en", "de", "es", "fr")

# Weight vectors (id, a weight for each dimension in order, meaning).
WEIGHTS = (
    ("W01", 1.00, 0.00, 0.00, 0.00, 0.00, "Edu only"),
    ("W02", 0.00, 1.00, 0.00, 0.00, 0.00, "Reasoning only"),
    ("W03", 0.00, 0.00, 1.00, 0.00, 0.00, "Professionalism only"),
    ("W04", 0.00, 0.00, 0.00, 1.00, 0.00, "Cleanliness only"),
    ("W05", 0.00, 0.00, 0.00, 0.00, 1.00, "Cultural only"),
    ("W06", 0.20, 0.20, 0.20, 0.20, 0.20, "Equal average"),
    ("W07", 0.40, 0.20, 0.20, 0.10, 0.10, "Edu-heavy"),
    ("W08", 0.25, 0.35, 0.20, 0.10, 0.10, "Reasoning-heavy"),
    ("W09", 0.25, 0.15, 0.35, 0.15, 0.10, "Professionalism-heavy"),
    ("W10", 0.25, 0.10, 0.10, 0.40, 0.15, "Cleanliness-heavy"),
    ("W11", 0.25, 0.10, 0.10, 0.15, 0.40, "Cultural-heavy"),
    ("W12", 0.35, 0.30, 0.20, 0.10, 0.05, "Edu + reasoning"),
    ("W13", 0.35, 0.10, 0.30, 0.15, 0.10, "Edu + professionalism"),
    ("W14", 0.30, 0.15, 0.15, 0.30, 0.10, "Edu + cleanliness"),
    ("W15", 0.30, 0.15, 0.15, 0.10, 0.30, "Edu + cultural"),
    ("W16", 0.20, 0.30, 0.25, 0.15, 0.10, "Reasoning + professionalism"),
    ("W17", 0.15, 0.35, 0.10, 0.30, 0.10, "Reasoning + cleanliness"),
    ("W18", 0.15, 0.35, 0.10, 0.10, 0.30, "Reasoning + cultural"),
    ("W19", 0.15, 0.10, 0.35, 0.30, 0.10, "Professionalism + cleanliness"),
    ("W20", 0.15, 0.10, 0.35, 0.10, 0.30, "Professionalism + cultural"),
    ("W21", 0.15, 0.10, 0.10, 0.35, 0.30, "Cleanliness + cultural"),
    ("W22", 0.30, 0.25, 0.25, 0.10, 0.10, "Edu + reasoning + professionalism"),
    ("W23", 0.30, 0.10, 0.10, 0.25, 0.25, "Edu + cleanliness + cultural"),
    ("W24", 0.10, 0.30, 0.10, 0.25, 0.25, "Reasoning + cleanliness + cultural"),
    ("W25", 0.30, 0.25, 0.10, 0.25, 0.10, "Edu + reasoning + cleanliness"),
    ("W26", 0.10, 0.10, 0.30, 0.25, 0.25, "Professionalism + cleanliness + cultural"),
)
EQUAL_WEIGHTS = dict.fromkeys(DIMENSIONS, 1 / len(DIMENSIONS))

# Selections that are compared, topic categories in order (their index is the gold answer), and answer letters.
BASELINES = ("random", "clean_heuristic", "equal_average", "best_weighted")
TOPICS = ("science/technology", "travel", "politics", "sports", "health", "entertainment", "geography")
LETTERS = ("A", "B", "C", "D", "E", "F", "G", "H")
ANSWER_LINE = "Select the one correct letter for the answer."

#: A stand-in for the external list of words that reject a document; pass a list of your own.
BANNED_WORDS = ("idiot", "moron", "scum")
CHARS_PER_TOKEN = 4.0
