"""Word lists, markers and constants that decide results.

Everything here is data that has to keep exactly these values; the logic that
uses it lives in the modules of this package.
"""

# ASCII letters and punctuation (the order of the character table).
UPPERCASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERCASE = "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"

# Unicode white space as a Java pattern, including the four separator controls.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# Contamination: gram sizes and cleaning windows.
QUESTION_NGRAM = 8
CORPUS_NGRAM = 13
CORPUS_BUCKETS = 500
FREQUENT_DOCS = 10
CLEAN_WINDOW = 200
CLEAN_MIN_CHARS = 200
CLEAN_MAX_MATCHES = 10

# Question filters and selection.
DIAGRAM_MARKER = "[asy]"
IMAGE_MARKER = "![Image]"
PICTURE_NUMBER = r"p[1-9][0-9]{0,2}\."
BOLD_WITH_DIGIT = r"(?d)\*\*(?=.*\d)[^\s\]]*\*\*"
HARD_DIFFICULTY = 6.5
MAX_SUBDOMAIN_CHARS = 30
LONG_TRACE = 5600
UNIFORM_DRAWS = 700
SAMPLE_SIZE = 1000

# Supervised chat text.
USER_TURN = "<|im_start|>user\n"
ASSISTANT_TURN = "<|im_start|>assistant\n"
TURN_END = "<|im_end|>\n"
THINK_TURN = "<|im_start|>think\n"
ANSWER_TURN = "\n<|im_start|>answer\n"
ANSWER_PREFIX = "Answer: "

# Prompt budget suffixes.
BUDGET_STEPS = "\n\nThink for up to {n} steps."
BUDGET_TOKENS = "\n\nThink for up to {n} tokens."
BUDGET_LONG = (
    "\n\nAnswer after a long amount of thinking. If you feel like you are finished"
    " early, spend the extra time trying to double-check your work until you are"
    " absolutely sure that you have the correct answer."
)
BUDGET_SHORT = (
    "\n\nAnswer after a short amount of thinking. Do not spend excessive time"
    " double-checking your work."
)

# Instruction prompts with and without an input field.
INSTRUCT_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that"
    " provides further context. Write a response that appropriately completes the"
    " request.\n\n### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
)
INSTRUCT_NO_INPUT = (
    "Below is an instruction that describes a task. Write a response that"
    " appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:\n"
)
META_WITH_INPUT = "{meta_prompt}\n{instruction}\n\n{input}\n\n### Dromedary"
META_NO_INPUT = "{meta_prompt}\n{instruction}\n\n### Dromedary"

# Step-reward text.
STEP_MARK = " ки\n"
STEP_MARK_PLAIN = " ки "

LIST_SPLITTER = " ;;; "

# Multiple-choice question block.
CHOICE_BLOCK = "{question}\nAnswer Choices:\n(A) {a}\n(B) {b}\n(C) {c}\n(D) {d}"

# Detokenizer rules: (kind, pattern or text, replacement), applied in this order.
DETOKENIZE = {
    "general": [
        ("text", " n't", "n't"),
        ("text", " )", ")"),
        ("text", "( ", "("),
        ("text", '" ', '"'),
        ("text", ' "', '"'),
        ("regex", r" (['.,])", "$1"),
    ],
    "dialog": [
        ("text", " '", "'"),
        ("text", " \n", "\n"),
        ("text", "\n ", "\n"),
        ("text", " n't", "n't"),
        ("text", "`` ", '"'),
        ("text", "''", '"'),
        ("text", " :", ":"),
        ("text", " ;", ";"),
        ("text", " !", "!"),
        ("text", " ?", "?"),
        ("text", " ,", ","),
        ("text", " .", "."),
    ],
    "wiki": [
        ("text", "s '", "s'"),
        ("regex", r"/' [0-9]/", "/'[0-9]/"),
        ("text", " @-@ ", "-"),
        ("text", " @,@ ", ","),
        ("text", " @.@ ", "."),
        ("text", " : ", ": "),
        ("text", " ; ", "; "),
        ("text", " . ", ". "),
        ("text", " ! ", "! "),
        ("text", " ? ", "? "),
        ("text", " , ", ", "),
        ("regex", r"\(\s*([^\)]*?)\s*\)", "($1)"),
        ("regex", r"\[\s*([^\]]*?)\s*\]", "[$1]"),
        ("regex", r"\{\s*([^}]*?)\s*\}", "{$1}"),
        ("regex", r"\"\s*([^\"]*?)\s*\"", '"$1"'),
        ("regex", r"'\s*([^']*?)\s*'", "'$1'"),
        ("text", "= = = =", "===="),
        ("text", "= = =", "==="),
        ("text", "= =", "=="),
        ("text", " ° ", "°"),
        ("text", " \n", "\n"),
        ("text", "\n ", "\n"),
        ("text", " N ", " 1 "),
        ("text", " 's", "'s"),
    ],
    "spacing": [
        ("text", "&lt;", "<"),
        ("text", "&gt;", ">"),
        ("text", "&quot;", '"'),
        ("text", "&#39;", "'"),
        ("text", "&#x27;", "'"),
        ("text", "&nbsp;", " "),
        ("text", "&amp;", "&"),
        ("regex", r"\s+([.,;:!?)])", "$1"),
        ("regex", r"(\s+|^)\(\s+([^)]+)\s+\)", "$1($2)"),
        ("regex", r"(\s+|^)\[\s+([^)]+)\s+\]", "$1[$2]"),
        ("regex", r'(\s+|^)"\s+([^"]+)\s+"', '$1"$2"'),
        ("regex", r"(\s+|^)'\s+([^']+)\s+'", "$1'$2'"),
    ],
    "brackets": [
        ("trim", "", ""),
        ("text", " [title]", ". "),
        ("regex", r"\[[^\n]*?\]", ""),
        ("text", "  ", " "),
    ],
}

# Answer markers and patterns.
INVALID = "[invalid]"
INVALID_FINAL = "[invalidanswer]"
PLACEHOLDER = "placeholder"
ANSWER_MARKERS = ["<|im_start|>answer\n", "<|im_start|>"]
ANSWER_LINE = r"(?is)Answer\s*:\s*(.*)"
BOXED_FLAT = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
SPECIAL_TOKENS = [
    "<|reserved_special_token_0|>",
    "<|reserved_special_token_1|>",
    "<|reserved_special_token_2|>",
]
NUMBER_GROUPED = r"-?\b\d{1,3}(?:,\d{3})+\b"
NUMBER_SCIENTIFIC = r"-?\d+(?:\.\d+)?[eE][+-]?\d+"
NUMBER_PLAIN = r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"

# Articles dropped by the question-answer normalizer.
ARTICLES = {"en": ["a", "an", "the"], "fr": ["un", "une", "des", "le", "la", "les"]}

# Number words.
NUMBER_UNITS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen",
]
NUMBER_TENS = [
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
]
NUMBER_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}

# Math text rules, applied in this order (kind, pattern or text, replacement).
MATH_COMPETITION = [
    ("text", "\n", ""),
    ("text", "\\!", ""),
    ("text", "\\\\", "\\"),
    ("text", "tfrac", "frac"),
    ("text", "dfrac", "frac"),
    ("text", "\\left", ""),
    ("text", "\\right", ""),
    ("text", "^{\\circ}", ""),
    ("text", "^\\circ", ""),
    ("text", "\\$", ""),
]
MATH_COMPETITION_REST = [
    ("text", "\\%", ""),
    ("text", " .", " 0."),
    ("text", "{.", "{0."),
]
MATH_QUANTITATIVE = [
    ("text", "an ", ""),
    ("text", "a ", ""),
    ("text", ".$", "$"),
    ("text", "\\$", ""),
    ("text", "\\ ", ""),
    ("text", " ", ""),
    ("text", "mbox", "text"),
    ("text", ",\\text{and}", ","),
    ("text", "\\text{and}", ","),
    ("text", "\\text{m}", "\\text{}"),
]
MATH_REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km",
    "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ",
    "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]
MATH_QUANTITATIVE_TEX = [
    ("regex", r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    ("regex", r"(\\text\{)(.*?)(\})", "$2"),
    ("regex", r"(\\textbf\{)(.*?)(\})", "$2"),
    ("regex", r"(\\overline\{)(.*?)(\})", "$2"),
    ("regex", r"(\\boxed\{)(.*)(\})", "$2"),
    ("regex", r"(frac)([^{])(.)", "frac{$2}{$3}"),
    ("regex", r"(sqrt)([^{])", "sqrt{$2}"),
    ("text", "$", ""),
]
MATH_GRADER = [
    ("regex", r"^\\text\{(.+?)\}$", "$1"),
    ("text", "\\%", "%"),
    ("text", "\\$", "$"),
    ("text", "$", ""),
    ("text", "%", ""),
    ("text", " or ", " , "),
    ("text", " and ", " , "),
    ("text", "million", "*10^6"),
    ("text", "billion", "*10^9"),
    ("text", "trillion", "*10^12"),
]
MATH_UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day",
    "week", "month", "year", "foot", "feet", "inch", "yard",
]
MATH_GRADER_TEX = [
    ("text", "\\tfrac", "\\frac"),
    ("text", "\\dfrac", "\\frac"),
    ("text", "\\frac", " \\frac"),
    ("regex", r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2"),
    ("regex", r"\\sqrt\{([^{}]*)\}", "sqrt$1"),
    ("text", "\\pi", "pi"),
    ("text", "\\infty", "inf"),
    ("text", "\\cup", "U"),
    ("text", "\\cdot", "*"),
    ("text", "\\times", "*"),
    ("trim", "", ""),
]
MATH_EXTRACTION = [
    ("trim", "", ""),
    ("text", "\n", ""),
    ("regex", r"\.+$", ""),
    ("text", "\\!", ""),
    ("regex", r"^\\text\{(.*)\}$", "$1"),
    ("text", "tfrac", "frac"),
    ("text", "dfrac", "frac"),
    ("text", "cfrac", "frac"),
    ("text", "\\left", ""),
    ("text", "\\right", ""),
]
MATH_EXTRACTION_REST = [
    ("text", "^{\\circ}", ""),
    ("trim", "", ""),
    ("text", "^\\circ", ""),
    ("trim", "", ""),
    ("regex", r"\{(c|m)?m\}(\^(2|3))?", ""),
    ("trim", "", ""),
    ("regex", r"p\.m\.$", ""),
    ("trim", "", ""),
    ("regex", r"(\d)\s*t$", "$1"),
    ("trim", "", ""),
    ("text", "\\$", ""),
    ("text", "$", ""),
    ("text", "x\\in", ""),
    ("text", "\\%", "%"),
    ("text", " .", " 0."),
    ("text", "{.", "{0."),
    ("text", "\\cdot", ""),
    ("text", "infinity", "\\infty"),
]
MATH_EXTRACTION_LAST = [
    ("text", "+\\inity", "\\infty"),
    ("text", "\\mathbf", ""),
    ("text", "\\mathrm", ""),
    ("regex", r"\\mbox\{.*?\}", ""),
]

# Words ignored when a referent is compared.
DETERMINERS = [
    "a", "an", "few", "her", "his", "each", "every", "many", "much", "my", "our",
    "some", "that", "the", "their", "these", "this", "those", "which", "whose", "your",
]

# Emotion scores: S-curve and the constant that gives a random answer zero.
EMOTION_SCALE = 6.5
EMOTION_SLOPE = -1.2
EMOTION_MIDDLE = 4
EMOTION_NEAR = 5
EMOTION_CONSTANT = 0.7477

# Instruction checks.
CONSTRAINED_RESPONSES = ["My answer is yes.", "My answer is no.", "My answer is maybe."]
ABBREVIATIONS = ["Mr", "St", "Mrs", "Ms", "Dr", "Inc", "Ltd", "Jr", "Sr", "Co", "Ph.D"]

# Tokenizer of the translation scores (kind, pattern, replacement), in this order.
TRANSLATION_TOKENS = [
    ("text", "<skipped>", ""),
    ("text", "-\n", ""),
    ("text", "\n", " "),
    ("text", "&quot;", '"'),
    ("text", "&lt;", "<"),
    ("text", "&gt;", ">"),
    ("text", "&amp;", "&"),
    ("regex", "^|$", " "),
    ("regex", r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    ("regex", r"([^0-9])([\.,])", "$1 $2 "),
    ("regex", r"([\.,])([^0-9])", " $1 $2"),
    ("regex", r"([0-9])(-)", "$1 $2 "),
]
CHRF_ORDER = 6
CHRF_BETA = 2
BLEU_ORDER = 4

# Step-reward examples: head of the question, its end if nothing is written yet, lead of the
# first output, text between question and written part.
STEP_REWARD_PARTS = {
    "v1": ("Question: ", "", "\n\nAnswer: ", "\n\nAnswer: "),
    "v2": ("# Question\n\n", "\n\n# Solution", "\n\n", "\n\n# Solution\n\n"),
    "v3": ("# Question\n\n", "\n\n# Solution\n\n", "", "\n\n# Solution\n\n"),
}

# Instruction texts with headings.
QUESTION_HEAD = "# Question\n\n"
SOLUTION_HEAD = "\n\n# Solution"
STARTER_HEAD = "\n\n# Starter Code\n\n```python\n"
STARTER_END = "\n```\n\n# Solution"
PROGRAM_START = "\n\n```python\n"
PROGRAM_END = "\n```\n"

# Traces: where the question starts and ends, pattern between steps.
TRACE_MARKS = {
    "reserved": (
        "user<|end_header_id|>\n\n",
        "Put your answer on its own line after",
        r"\n<\|reserved_special_token_[012]\|>\n",
    ),
    "steps": (
        "<|im_start|>user\n",
        "Put your answer on its own line after",
        r"<\|im_start\|>step\d+\n",
    ),
    "steps_left": (
        "<|im_start|>user\n",
        "\n\nThink for up to",
        r"<\|im_start\|>\d+ steps left\n",
    ),
}
STEP_NUMBER = "Step "
STEP_ANSWER = "The answer is: "
RESERVED_END = "<|eot_id|>"
RESERVED_ANSWER = "Answer:"
STEP_TURN_ANSWER = "<|im_start|>answer\nAnswer: "
NEXT_TURN = "\n<|im_start|>"

# Benchmark rows as messages.
CHOICE_ASK = "\nWhat of the following is the right choice? Explain your answer.\n"
BOXED_START = "\nSo the answer is $\\boxed{"
BOXED_END = "}$."
SHOTS_ASK = "\n从以下选项中选择:    "
FORMAL_TEXT = "(*### Problem\n\n{a}\n\n### Solution\n\n{b} *)\n\nFormal:\n{c}"
FORMAL_ANSWER = "placeholder"
