"""Lists, patterns and constants that results depend on. Each is stated once, in its natural order."""

from __future__ import annotations

#: Quote marks, and the straight ones that they become.
QUOTES_FROM, QUOTES_TO = "“”「」『』‘’", "\"\"\"\"\"\"''"
#: Full-width and vertical punctuation, and what it becomes.
PUNCTUATION_FROM, PUNCTUATION_TO = "　﹁﹂．", ' "".'

#: Words after which a full stop ends no sentence.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "st", "prof", "sr", "jr", "vs", "etc", "e.g", "i.e", "no", "col", "gen", "lt", "capt", "sgt", "rev", "hon", "mt", "ft"]
#: Spoken forms, in the order in which they apply.
SPOKEN = [(r"\betc\.", "et cetera"), (r"\be\.g\.", "for example"), (r"\bi\.e\.", "that is")]
ZH_DIGITS, ZH_UNITS, ZH_TEN_THOUSAND = "零一二三四五六七八九", ("千", "百", "十", ""), "万"

#: Headings of plain text by language; bare numerals; markdown headings; boilerplate markers.
HEADING = {
    "en": r"(?iU)^\s*(chapter|part|book)\s+([0-9]+|[ivxlc]+|\w+)\b.*$",
    "zh": r"(?U)^\s*第[0-9一二三四五六七八九十百千零〇]+[章回节卷部].*$",
}
BARE_NUMERAL = r"^\s*([0-9]+|[IVXLC]+)\.?\s*$"
MARKDOWN_HEADING = r"(?U)^(#{1,2})\s+(.+?)\s*#*\s*$"
BOILERPLATE_START = r"(?i)^\*\*\* ?START OF (THE|THIS) PROJECT GUTENBERG"
BOILERPLATE_END = r"(?i)^\*\*\* ?END OF (THE|THIS) PROJECT GUTENBERG"

#: Characters spoken in a second; audio tokens in a second; tokens that any sequence of a batch costs besides.
CHARS_PER_S, OTHER_CHARS_PER_S, TOKENS_PER_S, SEQUENCE_TOKENS = {"zh": 4.0, "en": 15.0}, 8.0, 12, 300
#: Ranges that count as one token a character in the estimate for language models.
CJK = r"[　-鿿豈-﫿＀-￯]"

SPEECH_VERBS = (
    "said|says|asked|asks|replied|replies|answered|cried|exclaimed|whispered|muttered|shouted|called|continued|added|observed|remarked|"
    "returned|repeated|interrupted|inquired|demanded|declared|began|went on|put in|murmured|laughed|sighed|snapped|insisted|protested|"
    "suggested|agreed|admitted|announced|breathed|growled|hissed"
)
ZH_SPEECH_VERBS = "说|道|问|答|答道|说道|问道|叫道|喊道|笑道|叹道|回答|接着说|继续说|低声说|大声说|开口"
#: A name is up to four words of any case, or lazily one to six Han characters.
NAME, ZH_NAME = r"((?:[\w'\-]+\.?\s?){1,4})", r"([一-鿿·]{1,6}?)"
#: Tags after and before a quote, in the order in which they are tried.
TAGS_AFTER = {"en": [rf"(?U)^\s*[,;:\-—]?\s*(?:{SPEECH_VERBS})\s+{NAME}", rf"(?U)^\s*[,;:\-—]?\s*{NAME}\s*(?:{SPEECH_VERBS})"], "zh": [rf"(?U)^\s*[，,]?\s*{ZH_NAME}(?:{ZH_SPEECH_VERBS})"]}
TAGS_BEFORE = {"en": [rf'(?U){NAME}\s*(?:{SPEECH_VERBS})[^"]{{0,40}}$', rf'(?U)(?:{SPEECH_VERBS})\s+{NAME}[^"]{{0,40}}$'], "zh": [rf"(?U){ZH_NAME}(?:{ZH_SPEECH_VERBS})[：:，,]?\s*$"]}
NO_NAMES = ["the", "a", "and", "but", "then", "there", "it", "that", "this"]
SENTENCE_PUNCTUATION = r"[.!?,;:。！？，；：…]"
#: How sure each way of finding a speaker is; from RULES on, rules found it.
NARRATED, TAGGED, SPLIT_QUOTE, CONTINUED, RULES, MODEL_MOST, MODEL_DEFAULT = 1.0, 0.95, 0.9, 0.85, 0.85, 0.8, 0.5

#: Paragraphs in a request, and paragraphs shown before them; tokens kept for the answer; least that must be left for text.
WINDOW_PARAGRAPHS, CONTEXT_PARAGRAPHS, OUTPUT_RESERVE, LEAST_WINDOW = 12, 4, 2048, 256

NEUTRAL = "neutral"
STYLES = {
    "angry": {"en": "angry, raised voice, sharp and forceful", "zh": "愤怒，提高音量，语气尖锐有力"},
    "sad": {"en": "sad, low, slow and subdued", "zh": "悲伤，低沉，缓慢而压抑"},
    "soft": {"en": "soft, gentle and quiet, almost a whisper", "zh": "轻柔，温和，小声，近乎耳语"},
    "urgent": {"en": "urgent, fast and tense, out of breath", "zh": "急促，紧张，语速很快，带着喘息"},
}
#: Seconds of silence: paragraph, speaker change, chapter. Verification: gap between clips, longest clip in a batch.
PAUSES = {"paragraph": 0.6, "speaker_change": 1.2, "chapter": 2.5}
CLIP_GAP_S, LONGEST_CLIP_S = 0.5, 28.0

#: Words that tell a gender: explicit ones win, relational ones break ties. Words that tell an age, in order.
FEMALE = r"(?i)\b(female|woman|girl|lady)\b|女性|女孩|女人|少女|姑娘"
MALE = r"(?i)\b(male|man|boy|gentleman)\b|男性|男孩|男人|少年"
FEMALE_RELATION = r"(?i)\b(she|her|mother|wife|daughter|sister|aunt|queen|princess|mrs|miss|ms)\b|她|母亲|妻|姐|妹|夫人|小姐|婆|妈"
MALE_RELATION = r"(?i)\b(he|his|him|father|husband|son|brother|uncle|king|prince|lord|mr|sir)\b|他|父亲|丈夫|兄|弟|叔|爷|老头|先生|哥"
AGES = [
    ("adult", r"(?i)\b(middle[- ]aged|adult|mature|grown)\b|中年|成年|大叔|大婶"),
    ("old", r"(?i)\b(old|elderly|senior|grandfather|grandmother|grandpa|grandma|veteran)\b|老年|老人|年长|年迈|爷爷|奶奶|老头|老太|[五六七八九]十岁|[5-9]\d岁"),
    ("young", r"(?i)\b(young|youth|teen|teenage|child|kid|boy|girl|student|1?\d\s*(?:years?|yrs?))\b|年轻|少年|少女|孩子|小孩|学生|青年|十[一二三四五六七八九]?岁|[一二三四五六七八九]岁|1?\d岁|2\d岁"),
]
#: Preset voices of each backend in order: identifier, language, gender, age, whether it suits a narrator.
VOICES = {
    "kokoro": [
        ("af_heart", "en", "f", "young", False), ("af_bella", "en", "f", "young", False), ("af_nicole", "en", "f", "young", False), ("af_sarah", "en", "f", "adult", False),
        ("af_sky", "en", "f", "young", False), ("am_adam", "en", "m", "adult", False), ("am_michael", "en", "m", "adult", True), ("am_echo", "en", "m", "young", False),
        ("am_eric", "en", "m", "adult", False), ("bf_emma", "en", "f", "adult", True), ("bf_isabella", "en", "f", "adult", False), ("bm_george", "en", "m", "old", True),
        ("bm_lewis", "en", "m", "adult", False), ("zf_xiaobei", "zh", "f", "young", False), ("zf_xiaoni", "zh", "f", "young", False), ("zf_xiaoxiao", "zh", "f", "adult", False),
        ("zf_xiaoyi", "zh", "f", "adult", False), ("zm_yunjian", "zh", "m", "adult", False), ("zm_yunxi", "zh", "m", "young", False), ("zm_yunxia", "zh", "m", "young", False),
        ("zm_yunyang", "zh", "m", "adult", True),
    ],
    "qwen3tts": [
        ("Vivian", "zh", "f", "young", False), ("Serena", "zh", "f", "young", False), ("Uncle_Fu", "zh", "m", "old", True), ("Dylan", "zh", "m", "young", False),
        ("Eric", "zh", "m", "adult", False), ("Ryan", "en", "m", "adult", True), ("Aiden", "en", "m", "young", False), ("Ono_Anna", "ja", "f", "young", False),
        ("Sohee", "ko", "f", "adult", False),
    ],
}
#: Names under which backends cache their output.
BACKEND_NAMES = {"kokoro": "kokoro-82m-v1.0", "tone": "tone-test", "chatterbox": "chatterbox-mtl", "qwen3tts": "qwen3tts-1.7B"}
#: Sample passages for designed voices: most characters by language, least of a piece, least of a passage.
SAMPLE_MOST, SAMPLE_PIECE, SAMPLE_LEAST = {"en": 160, "zh": 60}, 4, 12
