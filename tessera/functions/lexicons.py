"""Word lists, patterns and tables of the span and number rules."""

from __future__ import annotations

# Order of span types, most wanted first.
SPAN_PRIORITY = ["number", "question_target", "condition", "negation", "comparison", "operation", "cyber_security_term", "object", "entity", "relation"]

# English phrases by span type.
ENGLISH = {
    "question_target": ["How many", "How much", "What", "Which", "Who", "When", "Where", "Why"],
    "comparison": ["no more than", "no less than", "more than", "less than", "at least", "at most", "greater", "smaller", "higher", "lower", "cheaper", "fewer", "more", "less"],
    "negation": ["cannot", "without", "never", "can't", "not", "no"],
    "condition": ["assuming", "provided", "unless", "given", "when", "if"],
    "operation": [
        "deserializes", "deserialize", "executes", "execute", "encrypt", "decrypt", "upload", "download", "bypass", "exploit", "removes", "removed", "remove", "bought", "sells", "sold", "sell",
        "added", "adds", "add", "gives", "gave", "give", "takes", "took", "take", "remain", "total", "difference", "buys", "buy", "left",
    ],
    "cyber_security_term": ["remote code execution", "unsafe deserialization", "cross-site scripting", "privilege escalation", "buffer overflow", "command injection", "path traversal", "SQL injection"],
    "object": ["notebooks", "requests", "records", "packets", "servers", "apples", "pencils", "muffins", "marbles", "pages", "books", "files", "users", "items"],
}

# Chinese phrases by span type.
CHINESE = {
    "question_target": ["哪一个", "什么时候", "多少", "几个", "什么", "哪种", "谁", "何时", "哪里", "为什么", "几"],
    "comparison": ["不超过", "不少于", "更多", "更少", "大于", "小于", "高于", "低于", "至少", "至多", "超过", "少于"],
    "negation": ["没有", "从不", "不能", "无法", "不", "未", "无"],
    "condition": ["如果", "假设", "给定", "除非", "当", "若"],
    "operation": ["反序列化", "购买", "增加", "减少", "移除", "删除", "拿走", "剩下", "总共", "一共", "执行", "加密", "解密", "上传", "下载", "绕过", "利用", "买", "卖", "给"],
    "cyber_security_term": ["不安全反序列化", "远程代码执行", "SQL 注入", "跨站脚本", "权限提升", "缓冲区溢出", "命令注入", "路径遍历"],
    "object": ["笔记本", "数据包", "服务器", "苹果", "文件", "用户", "请求", "记录", "物品", "书"],
}

# Number patterns.
ARABIC_NUMBER = r"(?<![\dA-Za-z_,.])\d{1,3}(?:,\d{3})+(?:\.\d+)?%?|(?<![\dA-Za-z_,.])\d+(?:\.\d+)?%?"
CHINESE_NUMBER = r"[零一二三四五六七八九十百千万亿两]+"
NUMBER_NEIGHBOUR = r"\b\d+(?:\.\d+)?%?\s+([A-Za-z][A-Za-z_-]*)"
CJK = r"[一-鿿]"

# What a generalised span becomes.
GENERAL_ENGLISH = {
    "number": "some number",
    "entity": "some entity",
    "object": "some object",
    "operation": "some operation",
    "relation": "some relation",
    "comparison": "some comparison",
    "negation": "some negation condition",
    "condition": "some condition",
    "question_target": "some question target",
    "cyber_security_term": "some security issue",
}
GENERAL_CHINESE = {
    "number": "某个数量",
    "entity": "某个实体",
    "object": "某个对象",
    "operation": "某个操作",
    "relation": "某种关系",
    "comparison": "某种比较",
    "negation": "某个否定条件",
    "condition": "某个条件",
    "question_target": "某个问题目标",
    "cyber_security_term": "某个安全问题",
}

# Numbers as words, and words that imply a factor.
WORD_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
    "thousand": 1000, "million": 1000000, "dozen": 12,
}
IMPLICIT_NUMBERS = {"twice": 2.0, "double": 2.0, "doubled": 2.0, "triple": 3.0, "tripled": 3.0, "quadruple": 4.0, "half": 0.5, "quarter": 0.25, "third": 1.0 / 3.0}

# Identifier patterns of three families.
IDENTIFIERS = {
    "cve": r"(?i)\bCVE[\s-](\d{4})[\s-]?(\d{4,})\b",
    "attack": r"(?<![A-Za-z0-9-])T(\d{4})(?:\.(\d{3}))?(?![A-Za-z0-9])",
    "cwe": r"(?i)\bCWE[\s-](\d{1,5})\b",
}

# Phrases of stated confidence.
CONFIDENCE = {
    "high": r"(?i)\b(certainly|definitely|confident|clearly|exactly|known as)\b",
    "medium": r"(?i)\b(likely|probably|typically|commonly|appears to|seems to)\b",
    "low": r"(?i)\b(possibly|perhaps|may|might|could be|i think|not sure)\b",
}

# Words of the drift rules.
GENERIC_QUANTITIES = [
    "some", "several", "a few", "few", "many", "a number", "a number of", "a couple", "couple", "multiple", "various", "numerous", "a lot", "lots", "a handful", "handful", "certain", "n", "x", "y", "a", "an",
    "the", "several of", "some of",
]
DIRECTIONS = {
    "more": ["more", "more than", "greater", "greater than", "larger", "bigger", "over", "above", "at least"],
    "less": ["less", "less than", "fewer", "fewer than", "smaller", "lower", "under", "below", "at most"],
    "equal": ["equal", "equal to", "same", "as many", "as much"],
}
NEGATIONS = ["not", "no", "never", "without", "none", "cannot", "n't", "neither", "nor"]
UNITS = [
    "mile", "miles", "km", "kilometer", "kilometers", "meter", "meters", "m", "hour", "hours", "hr", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "kg", "gram", "grams", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "liter", "liters", "gallon", "gallons", "cup", "cups", "dollar", "dollars", "cent", "cents", "percent", "%", "$", "foot", "feet",
    "inch", "inches", "yard", "yards", "per",
]
VAGUE_OBJECTS = ["items", "things", "objects", "stuff"]

# Patterns of the extractor of question spans by family.
RATE_PHRASE = r"(?i)\b\d+(?:\.\d+)?%?\s+[A-Za-z]+(?:\s+[A-Za-z]+)?\s+(?:each|per|apiece)\b"
NUMBER_UNIT_PHRASE = r"(?i)\b\d+(?:\.\d+)?%?(?:\s+[A-Za-z][A-Za-z'-]*){1,2}\b"
NUMBER_WORD = (
    r"(?i)\b(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|"
    r"dozen|half|twice|double|triple|quadruple|quarter)\b"
)
FAMILY_PHRASES = {
    "question_target": ["How many are left", "How much did [A-Za-z]+ spend", "What is the total", "How many", "How much", "How far", "What"],
    "comparison": ["more than", "less than", "fewer than", "older than", "younger than", "twice as many", "half as many", "at least", "at most", "difference between", "greater than", "smaller than"],
    "negation": ["not", "without", "except", "never", "no"],
    "condition": ["unless", "if", "after", "before", "only", "instead", "when", "given"],
    "operation": [
        "bought", "buy", "sold", "sell", "gave", "give", "left", "remaining", "total", "each", "per", "spent", "cost", "earned", "lost", "shared", "divided", "increased", "decreased", "altogether", "combined", "plus",
        "minus", "times",
    ],
}
COUNTED_WORD = r"\b\d+(?:\.\d+)?%?\s+([A-Za-z][A-Za-z'-]{2,})\b"
CAPITALIZED_WORD = r"\b[A-Z][a-zA-Z'-]{2,}\b"
PLURAL_WORD = r"\b[a-z][a-zA-Z'-]{3,}s\b"
NO_OBJECTS = [
    "how", "many", "much", "what", "which", "when", "where", "why", "the", "and", "then", "than", "with", "from", "that", "this", "into", "each", "per", "after", "before", "only", "total", "left", "more", "less", "does",
    "did", "will", "would", "there", "were", "have", "has", "had", "if",
]
