"""Values that results depend on and that therefore are fixed: patterns, word lists, templates, defaults."""

#: Code points that str.strip() removes (as ranges of a character class).
WHITE = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

#: Text fields in order of preference.
TEXT_FIELDS = ["text", "content", "body", "page_content"]
FIRST_TEXT_FIELDS = ["text", "content", "paragraph", "data"]

#: Sentinel ids and labels.
IGNORED = -100
BOS, EOS = 0, 1
BYTE_SHIFT = 4

#: Chat templates.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
CHATML_USER_PROMPT = "Please continue this document."
PREFIX_ROLES = {"system": "### System:\n", "user": "### User:\n", "assistant": "### Assistant:\n"}
PREFIX_STOPS = ["\n### User:", "\n### System:", "\n### Assistant:"]

#: Patterns of text that looks like code (searched without case).
CODE_PATTERNS = [
    r"```",
    r"\bimport\s+[a-z0-9_.]+",
    r"\bfrom\s+[a-z0-9_.]+\s+import\b",
    r"\bdef\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(",
    r"\bclass\s+[A-Z][a-zA-Z0-9_]*\b",
    r"\bpublic\s+class\b",
    r"\bconsole\.log\s*\(",
    r"<(?:!DOCTYPE|html|body|script)\b",
    r"#include\s*<",
    r"\bSELECT\b.+\bFROM\b",
    r"\bfunction\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(",
    r"\breturn\s+\{",
    r"\bTraceback\b",
    r"\bException\b",
]
#: The shorter pattern of code in responses, and the other patterns and sentences that filters look for.
RESPONSE_CODE = r"```|<(?:(?:!DOCTYPE)|html|body|script)\b|\bimport\s+[A-Za-z0-9_.]+|\bdef\s+\w+\s*\(|\bpublic\s+class\b|#include\s*<"
PROGRAMMING_REQUESTS = [
    r"```",
    r"\bwrite\s+(?:a|an|the)?\s*(?:function|script|program|class)\b",
    r"\bdebug\b.+\b(?:code|script|function|program|query)\b",
    r"\bjson\s+object\b",
    r"\breturn\s+json\b",
    r"\bstack\s+trace\b",
    r"\btraceback\b",
    r"\bregex\b",
    r"\bapi\b.+\bendpoint\b",
]
WORD = r"[A-Za-z']+"
PLACEHOLDER = r"\[[^\]]{1,40}\]"
URL = r"https?://|www\."
JSON_KEY = r'"[A-Za-z0-9_ -]+"\s*:\s*'
LIST_ITEM = r"^\s*(?:[-*]|\d+[.)])\s+"
LETTER_OPENING = "dear "
LETTER_SENTENCE = "i hope this message finds you well"

#: Words that name no topic.
TOPIC_STOP_WORDS = [
    "that", "this", "with", "have", "your", "from", "what", "when", "where",
    "which", "there", "their", "about", "would", "could", "should", "does",
    "just", "some", "more", "they", "them", "then", "will", "want", "tell",
    "give", "make", "help", "here", "into", "been", "very", "also", "such",
    "like", "know", "think", "good", "well", "these", "those", "other",
]

#: Signals of the named response checks.
GREETING = ["hi", "hello", "hey", "doing", "good", "great", "fine", "well", "thanks", "nice"]
EMPATHY = ["sorry", "rough", "tough", "understand", "sounds", "feel", "hope", "better", "hang in", "that's hard", "must be", "that can be"]
PERSONA = ["spark", "assistant", "model", "ai", "chatbot", "my name", "i'm", "called", "i am"]
UNCERTAINTY = [
    "can't predict", "cannot predict", "uncertain", "financial advisor", "consult", "no way to know", "difficult to", "i don't know",
    "hard to say", "not sure", "risky", "no one knows", "impossible to", "nobody can", "depends on", "i wouldn't",
]
MEAT = ["chicken", "beef", "pork", "turkey", "bacon", "ham", "salmon", "tuna", "shrimp", "fish"]
ADA_SIGNALS = ["analytical engine", "mathematic", "computer", "algorithm"]
ADA_WRONG = {"v7": ["french actress", "british actress", "nobel", "dragon tattoo", "tolkien"], "v5": ["french actress", "nobel", "dragon tattoo", "tolkien", "queen of hearts"]}
CAUTION = ["not sure", "uncertain", "say so", "clarifying", "clarify", "i don't know", "should say", "should be honest"]
OVERCONFIDENT = ["make something up", "guess confidently", "pretend"]
BOOKSHOPS = ["bookstore", "bookstores", "bookshop"]
WALKS = ["walk", "walking", "stroll"]
LETTERS = ["dear ", "sincerely", "i hope this email finds you well"]
DEBUG_TERMS = ["reproduce", "logs", "check", "trace", "rollback", "error", "request"]
CLARIFYING = ["what", "which", "can you share", "more detail", "what are you trying"]
SCATTERING = ["scatter", "scattering", "atmosphere"]

#: Short names of known sources.
SOURCE_SLUGS = {
    "HuggingFaceFW/fineweb-edu": "fineweb_edu",
    "mlfoundations/dclm-baseline-1.0": "dclm",
    "HuggingFaceFW/finepdfs": "finepdfs",
    "HuggingFaceFW/finewiki": "finewiki",
    "HuggingFaceTB/smollm-corpus": "cosmopedia",
    "kejian/codesearchnet-python-raw": "code",
    "open-web-math/open-web-math": "math",
}

#: Most tokens of an assistant message, and most words, by version of the chat set.
MAX_ASSISTANT_TOKENS = {"v4": 384, "v5": 192, "v6": 256, "v7": 256}
MAX_ASSISTANT_WORDS = {"v5": 140, "v6": 200, "v7": 200}
EARLY_LABELS = 32
TOKENS_PER_STEP = 1_048_576
