"""Vocabularies, constants and formats that define results.

Patterns are written with ``\\b`` for an ASCII word boundary and ``$`` for the absolute end; see
``functions.patterns`` for their form in Spark's and DuckDB's dialects.
"""

# ---------------------------------------------------------------------------------------------
# They must have exactly these contents for right results.
# ---------------------------------------------------------------------------------------------

SCOPES = ("identity", "global", "project", "daily")
STATUSES = ("active", "outdated", "archived", "pending")
SOURCES = ("auto", "dialogue", "import", "manual")
DECISIONS = ("new", "merge", "update", "ignore")

NEGATIONS = ("不需要", "不要", "不用", "禁止", "避免", "别", "不", "never", "avoid", "don't", "do not", "not", "no")

ZH_PREFERENCE = ("我(?:更)?(?:喜欢|偏好|倾向于|习惯)", "我(?:希望|想要|要求)", "以后(?:都|请|要)", "接下来(?:都|请)", "默认(?:用|走|是)", "请(?:你)?(?:都|始终|一直)", "(?:都|统一|一律)(?:用|走|采用)", "尽量")
ZH_DIRECTIVE = ("^(?:以后|接下来|今后|后续)?(?:都|统一|一律|尽量|默认)?(?:用|走|采用|使用)(.*)$",)
ZH_PROHIBITION = ("不要", "不需要", "不用", "别(?:再|去|要)?", "禁止", "避免", "不准", "不许", "千万不")
ZH_CORRECTION = ("更正", "修正", "不是.{0,20}?而是", "不是.{0,20}?是", "搞错", "说错", "记错", "应该是")
ZH_IDENTITY = ("我是", "我叫", "我的名字", "称呼我", "叫我", "我(?:的)?职业", "我(?:的)?身份", "我(?:的)?角色")
ZH_AGREEMENT = ("就(?:这么|这样|按这个)", "确定(?:用|走|采用)", "决定(?:用|走|采用)", "选定", "敲定", "最终(?:选|用|决定)", "同意", "可以就这样")
ZH_REMEMBER = ("记住", "记一下", "记下来", "帮我记", "收录", "备查")
ZH_FACT = ("我们的?项目", "我们(?:团队|公司|组)", "我(?:们)?(?:用的?|使用的?)(?:是|技术栈)", "现状(?:是|为)", "目前(?:用|是)", "背景(?:是|为)")
ZH_FACT_CAPTURE = ("(?:我们这个?项目|我们(?:团队|公司|组)|这个?项目|本?项目)(.*)$",)
ZH_SESSION_RECALL = ("我之前(?:说过|提过|讲过)", "我上次(?:说过|提过)", "你(?:还)?记得", "还记得吗")
EN_PREFERENCE = (r"\bi (?:prefer|like|want|need|would rather)\b", r"\balways\b", r"\bplease (?:always|use|prefer)\b", r"\bfrom now on\b", r"\bgoing forward\b", r"\bdefault to\b", r"\bwhenever\b", r"\btry to\b")
EN_PROHIBITION = (r"\bnever\b", r"\bdon'?t\b", r"\bdo not\b", r"\bavoid\b", r"\bno need to\b", r"\bplease don'?t\b")
EN_DIRECTIVE = (r"\buse\b",)
EN_CORRECTION = (r"\bactually\b", r"\bcorrection\b", r"\bnot\b.{0,30}?\bbut\b", r"\bi (?:meant|said)\b", r"\bthat'?s wrong\b", r"\bupdate that\b")
EN_IDENTITY = (r"\bmy name is\b", r"\bi am a\b", r"\bi'?m a\b", r"\bcall me\b", r"\bmy role\b", r"\bi work (?:as|on)\b")
EN_AGREEMENT = (r"\blet'?s go with\b", r"\bwe'?ll use\b", r"\bdecided (?:on|to use)\b", r"\bsettled on\b", r"\bagreed\b", r"\bfinal answer\b")
EN_REMEMBER = (r"\bremember (?:that|this)\b", r"\bnote that\b", r"\bkeep in mind\b", r"\bmake a note\b", r"\bfor the record\b")
EN_FACT = (r"\bour project\b", r"\bour team\b", r"\bour stack\b", r"\bwe use\b", r"\bcurrently we\b")
EN_SESSION_RECALL = (r"\bi (?:mentioned|said|told you)\b", r"\bdo you remember\b", r"\bas i said\b")

CORRECTION_LEAD_IN = "^(?:更正|修正|改(?:一下|正)?|勘误|纠正)(?:一下|下|一点|个)?$"
SESSION_SCOPED = (
    "(?:这次|本次|这一次|当前这|这一轮|这个?(?:会话|对话|任务|改动|需求|文件|函数|报错|bug))",
    r"\b(?:this (?:time|session|task|change|file|function|error|bug|request)|for now|right now|in this (?:case|instance))\b",
)
VAGUE = (
    "^(?:那样|这样|照旧|老样子|同上|如上|跟之前一样|一如既?往|按照?之前(?:说|提|讲)?的?(?:那样|那个|那些)?)[。.!！]?$",
    "^(?:之前(?:说|提|讲)的?(?:那样|那个|那些)|上次(?:说|提)的?)[。.!！]?$",
    r"^(?:that|this|the same|as before|like before|same as (?:before|last time)|the usual|same thing|as discussed|as (?:we|i) discussed)\s*[.!]?$",
)
HEDGES = ("(?:可能|也许|大概|或许|说不定|我猜|应该是吧|不确定)", r"\b(?:maybe|perhaps|probably|i guess|not sure|might be|i think)\b")
QUESTIONS = (
    r"[?？]\s*$",
    r"(?:吗|呢|吧)\s*[?？]?\s*$",
    "^(?:什么|怎么|如何|为什么|哪里|哪个|谁|何时|是否)",
    "^(?:what|how|why|where|which|who|when|is |are |should |could |would )",
)
EXPLICIT_MARKERS = ("(?:记住|记一下|记下来|帮我记|收录|备查)", r"\b(?:remember (?:that|this)|make a note|note that|keep in mind|for the record)\b")

CLAUSE_DELIMITER = r"[。！？!?；;，,、.]+[\s]*|\n+"
LIST_MARKER = r"^(?:[-*•·>]|[0-9]+[.)、])\s+"
CLEAN_HEAD = r"^[\s:：,，、.。;；!！?？\-–—*·]+"
CLEAN_TAIL = r"[\s:：,，、.。;；]+$"
LEADING_MARK = r"^(?:[-*•·>]+|[0-9]+[.)、]|#{1,6})\s*"
ATTACHMENT_MARKER = "[上传附件正文]"

GLOBAL_MARKERS = "(?:我(?:个人)?(?:喜欢|偏好|习惯|希望)|我的习惯|我一贯|by default i|personally i|my preference)"
PROJECT_MARKERS = "(?:这个?项目|本?项目|我们(?:项目|团队|组|公司)|代码库|这个?仓库|this project|our (?:project|team|repo|codebase)|the codebase)"
IDENTITY_MARKERS = "(?:我是|我叫|我的名字|称呼我|叫我|my name is|call me|i am a|i'?m a)"
TECHNOLOGY_MARKERS = (
    r"(?:\b(?:pnpm|npm|yarn|bun|node|deno|bun|typescript|javascript|python|rust|go|java|kotlin|swift|ruby|php|react|vue|svelte|angular|solid|next|nuxt|vite|webpack"
    r"|rollup|esbuild|tsdown|sqlite|postgres|mysql|mongodb|redis|docker|kubernetes|k8s|terraform|nginx|graphql|rest|grpc|tailwind|sass|less|jest|vitest|mocha"
    r"|playwright|cypress|eslint|prettier|biome)\b|(?:数据库|前端|后端|框架|语言|构建|部署|测试框架|包管理|依赖))"
)

#: Each adds one to the importance; the second applies to prohibitions only.
IMPORTANCE_EXPLICIT = "(?:记住|记一下|记下来|帮我记|remember (?:that|this)|make a note|note that)"
IMPORTANCE_REPLACEMENT = r"(?:改用|换成|而是|instead|use\b)"
IMPORTANCE_RULE = "(?:永远|始终|一直|每次都|一律|always|never|every time|without exception)"
IMPORTANCE_REASON = r"(?:因为|由于|原因是|because|since|as\b)"
IMPORTANCE_ACTIONABLE = r"(?:^|\s)[./~][A-Za-z0-9_./-]+|`[^`]+`|\b[a-z-]+ --?[A-Za-z0-9_-]+"

BASE_IMPORTANCE = {"correction": 9, "prohibition": 8, "identity": 8, "preference": 6, "agreement": 6, "fact": 4}
BASE_SCOPE = {"identity": "identity", "correction": "global", "prohibition": "global", "preference": "global", "agreement": "project", "fact": "project"}

MIN_CHARS, MAX_CHARS, BODY_CAP = 4, 500, 8000
TAG_CHARS, TAG_CAP = 48, 12
MESSAGE_CANDIDATES, BATCH_CANDIDATES = 16, 64
TRIGRAM_FLOOR, MAX_FRAGMENT_CHARS, MAX_FRAGMENTS, CJK_TERM_CHARS = 3, 64, 8, 4
RETRIEVE_LIMIT, CANDIDATE_FACTOR, CANDIDATE_CAP, AGREEMENT_BOOST = 10, 4, 200, 1.25
WEIGHTS, HALF_LIFE_DAYS = (0.6, 0.25, 0.15), 14.0
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
MERGE_SIMILARITY, CONTAINMENT_THRESHOLD, CONTRADICTION_OVERLAP = 0.42, 0.85, 0.6
POOL_LIMIT, VISIBLE_LIMIT, PANEL_TEXT_CHARS, EXPORT_LIMIT = 1000, 600, 600, 5000
DAILY_IMPORTANCE, DAILY_RETENTION_DAYS, DAILY_LIMIT = 2, 30, 60
TURN_BUDGET, INDEX_BUDGET, CARD_RECALL, STEP_QUERY_CHARS, DELIVERED_CAP = 4000, 900, 4, 2000, 500
IMPORT_ITEMS, IMPORT_FILES, IMPORT_BYTES, IMPORT_SAMPLES = 500, 200, 64 * 1024 * 1024, 6
ELEMENT_BYTES_EXPORT, ELEMENT_BYTES_GENERIC, WHOLE_JSON_BYTES, RULE_FILE_BYTES = 32 * 1024 * 1024, 16 * 1024 * 1024, 4 * 1024 * 1024, 32 * 1024
SNIFF_BYTES = 64 * 1024

SCOPE_LABEL = {"identity": "身份", "global": "全局", "project": "项目", "daily": "日志"}
SCOPE_TITLES = {"identity": "身份层 Identity", "global": "全局记忆 Global", "project": "项目记忆 Project", "daily": "每日日志 Daily"}
TITLE_MAX_CHARS, TITLE_ELLIPSIS = 48, "…"
INDEX_HEADER, CARD_HEADER, CONSTRAINT_HEADER = "[记忆索引 · %d 条]", "[相关记忆 · %d 条 · 按相关度]", "[必须遵守的记忆约束 · %d 条]"
CONSTRAINT_PREFIX = "- 必须："
TRUNCATION_MARKER = " …[已截断]"
RULE_HEADING = "### 规则："
UNNAMED_PROJECT = "(未命名项目)"

WRAPPER_KEYS = ("memories", "items", "entries", "data")
TEXT_KEYS = ("text", "content", "memory", "note", "body", "value")
TITLE_KEYS = ("title", "name", "subject")
CONVERSATIONS_FILE = r"^conversations(-[0-9]+)?\.json$"
NOTE_TYPES = ("user", "feedback", "reference", "project", "other")
GENERATED_NOTES = ("MEMORY.md", "memory_summary.md")
STORE_MARKERS = {".deepseek-harness": "dsh", ".workbuddy": "workbuddy", ".codebuddy": "codebuddy"}
SCAFFOLD_LINES = (r"^[ \t]*>[ \t]*last updated[ \t]*:", r"^[ \t]*>[ \t]*version[ \t]*:", r"^[ \t]*#{1,6}[ \t]+user memory profile[ \t]*$", r"^[ \t]*#{1,6}[ \t]+memory block[ \t]*$")
LABEL_TITLE_CHARS, LABEL_CHARS = 40, 60

# Fixed values of note and memory files: patterns that decide which lines are headers, marks and fill-in text.
NOTE_HEADER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
NOTE_FIELD = r"(?m)^([ \t]*)([A-Za-z0-9_-]+)[ \t]*:[ \t]*(.*?)[ \t]*$"
NOTE_INLINE_TYPE = r"(?:^|[,{]\s*)type\s*:\s*([^,}]+)"
NOTE_PROJECT = r"^(.+?)-[0-9a-fA-F]{16}$"
RAW_BLOCK = r"(?s)<!--[ \t]*RAW_JSON_START.*?RAW_JSON_END[ \t]*-->"
RAW_OPEN = r"(?s)(?:\A|\n)[^\n]*RAW_JSON_START.*\z"
SECTION_HEADING = r"^#{1,3}[ \t]+(.+?)[ \t]*$"
SECTION_BOLD = r"^\*\*(.+?)\*\*$"
ANY_HEADING = r"^#{1,6}[ \t]+(.+?)[ \t]*$"
BULLET = r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+(.*)$"
RULE_LINE = r"^[ \t]*([-*_])[ \t]*(?:\1[ \t]*){2,}$"
SECTIONED_NAME, DAY_NAME = r"(?i)^(?:memory|.+_memory)\.md$", r"^\d{4}-\d{2}-\d{2}\.md$"
EMPHASIS, EMPHASISED_HINT = r"\*\*|__|`|~~", r"[_*]{1,2}\([^)]*\)[_*]{1,2}"
FIELD_NAME = r"(?U)\A[-*>#\s]*[^:：\n]{0,40}[:：]\s*"
FILL_IN = r"(?i)^\(?\s*(?:optional|required|todo|tbd|n/a|待定|可选)\s*\)?$"
