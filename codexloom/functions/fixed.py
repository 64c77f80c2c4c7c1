"""Names, patterns, word lists and labels that results depend on."""

# Fixed values, in the order in which they take precedence.
TEXT_KINDS = ["paragraph", "list_item", "reference", "caption", "other"]
ATOMIC_KINDS = ["formula", "picture", "code"]
LABEL_KINDS = {
    "title": "title", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item",
    "table": "table", "formula": "formula", "caption": "caption", "reference": "reference", "picture": "picture", "code": "code",
    "page_header": "other", "page_footer": "other",
}
FURNITURE_LABELS = ["page_header", "page_footer"]

SCRIPTS = {"ja": r"[\u3040-\u30ff]", "ko": r"[\uac00-\ud7af]", "ar": r"[\u0600-\u06ff]", "ru": r"[\u0400-\u04ff]"}
HAN = r"[\u3400-\u9fff]"
MARKERS = {
    "fr": [" le ", " la ", " des ", " une ", " est "],
    "de": [" der ", " die ", " das ", " und ", " ist "],
    "es": [" el ", " los ", " una ", " que ", " para "],
    "pt": [" os ", " uma ", " que ", " para ", " não "],
    "en": [" the ", " and ", " of ", " to ", " is "],
}
STOPWORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "for", "is", "are", "this", "that", "we", "本文", "一种", "以及", "进行"]
DISCOURSE = ["however", "in contrast", "on the other hand", "nevertheless", "therefore", "in conclusion", "然而", "相比之下", "另一方面", "综上", "因此"]

#: Ideographs as the token estimate counts them (three ranges, unlike HAN).
CJK = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of SPACE in ASCII.
ASCII_SPACE = r"[\t-\r\x1c-\x20]+"
#: The characters of SPACE.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = r"[.!?。！？；;][\]\)）】'\"]*$"
SENTENCE_BREAK = r"(?<=[.!?。！？；;؟؛])\s+|(?<=[。！？；])"
#: Formulas and citations that a sentence is never cut in.
PROTECTED = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]|\[\d+(?:\s*[-,]\s*\d+)*\]"
WORD_HYPHEN = r"[A-Za-z]{2,}-$"
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?\p{Nd}+(?:[.,]\p{Nd}+)*(?:%|[a-zA-Z]+)?"
FORMULA = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"
CITATION = r"\[\d+(?:\s*[-,]\s*\d+)*\]"
FORMULA_IN_BLOCK = r"(?s)\$[^$]+\$|\\\(.+?\\\)|\\\[.+?\\\]"
AUTHOR_YEAR = r"\([A-Z][A-Za-z-]+(?: et al\.)?,?\s+\d{4}[a-z]?\)"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
SEPARATOR_ROW = r"^\s*\|?\s*:?-{3,}"
CAPTION = r"(?i)^\s*(?:(?:Table|Figure|Fig\.)\s+\d+\s*[.:]|[表图]\s*\d+\s*[：:.])\s*.+$"
CLOSERS = ".!?。！？；;؟؛])）】"

#: Token limits of chunks: soft, hard and least; and table rows in a chunk.
SOFT_TOKENS, HARD_TOKENS, LEAST_TOKENS, TABLE_ROWS = 1800, 2400, 120, 20
LONG_PARAGRAPH = 2000

RISK_MESSAGES = {
    "TABLE": "表格需保持行列结构并人工复核",
    "FORMULA": "公式需检查符号与编号是否完整",
    "REFERENCE": "引用密集片段需检查编号与作者年份对应关系",
    "LONG_PARAGRAPH": "超长段落需在切块阶段按句边界拆分",
    "STRUCTURE": "检测到双栏版面，已按左栏后右栏修正阅读顺序",
}
COHERENCE_MESSAGES = {"SEMANTIC_DISCONTINUITY": "当前 chunk 可能切断了上一句，建议对照原文复核", "BOUNDARY_MODEL_FAILED": "跨 chunk 连贯性检查失败，已保留译文并提示人工复核"}
SEQUENCE_MESSAGES = {"NUMBER_MISMATCH": "数字或单位序列与原文不一致，建议人工复核", "FORMULA_MISMATCH": "公式序列与原文不一致，建议人工复核", "CITATION_MISMATCH": "引用序列与原文不一致，建议人工复核"}
STRUCTURE_MESSAGES = {"TABLE": "表格行数与原文不一致", "FORMULA": "公式分隔符数量不一致", "REFERENCE": "引用标记数量不一致"}
ISSUE_TYPES = {
    "TABLE": "TABLE", "OMISSION": "OMISSION", "TERMINOLOGY": "TERMINOLOGY", "NUMBER": "NUMBER_MISMATCH", "NUMBER_MISMATCH": "NUMBER_MISMATCH",
    "FORMULA": "FORMULA_MISMATCH", "FORMULA_MISMATCH": "FORMULA_MISMATCH", "CITATION": "CITATION_MISMATCH", "CITATION_MISMATCH": "CITATION_MISMATCH", "REFERENCE": "REFERENCE",
}
STATUS_LABELS = {
    "UPLOADED": "等待处理", "PARSED": "解析完成", "WAITING_TERM_REVIEW": "等待术语确认", "WAITING_STYLE_REVIEW": "等待风格确认", "WAITING_RISK_REVIEW": "等待风险审核",
    "WAITING_CHAPTER_REVIEW": "等待章节审核", "TRANSLATING": "翻译中", "COMPLETED": "已完成", "FAILED": "失败，可恢复", "CANCELLED": "已取消",
}
RISK_LABELS = {
    "TABLE": "表格结构", "FORMULA": "公式结构", "REFERENCE": "引用完整性", "STRUCTURE": "版面结构", "LONG_PARAGRAPH": "超长段落", "PARSER_WARNING": "解析异常", "OMISSION": "疑似漏译",
    "TERMINOLOGY": "术语不一致", "NUMBER_MISMATCH": "数字或单位不一致", "FORMULA_MISMATCH": "公式不一致", "CITATION_MISMATCH": "引用不一致", "INCOMPLETE_SENTENCE": "句子可能不完整",
    "CROSS_PAGE_UNCERTAIN": "跨页语义不确定", "SEMANTIC_DISCONTINUITY": "上下文不连贯", "FORCED_TOKEN_SPLIT": "达到长度上限后强制切分", "OCR_TEXT_BREAK": "OCR 文本断裂", "BOUNDARY_MODEL_FAILED": "语义判断已降级",
}
#: Statuses from which a job may be cancelled, and those that are final.
CANCELLABLE = ["UPLOADED", "PARSED", "WAITING_TERM_REVIEW", "WAITING_STYLE_REVIEW", "WAITING_RISK_REVIEW", "WAITING_CHAPTER_REVIEW", "TRANSLATING"]
FINAL = ["COMPLETED", "FAILED", "CANCELLED"]
#: How a version of a translation came about.
VERSION_SOURCES = ["LLM_TRANSLATION", "AUTO_REVISION", "USER_EDIT", "RESTORE"]
#: Statuses that wait for a person, the stages where the run ends, and what follows.
PAUSE_STAGES = {"WAITING_TERM_REVIEW": "interrupt_for_term_review", "WAITING_STYLE_REVIEW": "interrupt_for_style_review", "WAITING_RISK_REVIEW": "mark_risks", "WAITING_CHAPTER_REVIEW": "save_checkpoint"}
RESUMED = {"WAITING_TERM_REVIEW": "WAITING_STYLE_REVIEW", "WAITING_STYLE_REVIEW": "TRANSLATING", "WAITING_RISK_REVIEW": "TRANSLATING", "WAITING_CHAPTER_REVIEW": "TRANSLATING"}
STAGE_LABELS = {
    "uploaded": "等待 Worker", "parse_document": "解析文档", "detect_language": "检测语言", "discover_boundary_candidates": "发现疑似边界", "analyze_semantic_boundaries": "语义边界判断",
    "fallback_boundary_analysis": "边界规则降级", "normalize_cross_page_text": "修复跨页文本", "split_sections": "结构化切分", "extract_terms": "抽取术语", "interrupt_for_term_review": "等待术语确认",
    "pretranslate_sample": "生成预翻译", "interrupt_for_style_review": "等待风格确认", "translate_chunk": "翻译片段", "mark_risks": "质量与风险检查", "summarize_chunk_context": "更新上下文摘要",
    "save_checkpoint": "保存检查点", "generate_outputs": "生成输出", "validate_outputs": "校验输出", "generate_report": "生成报告与结果包", "completed": "已完成",
}
ENTITY_TYPES = ["CHARACTER", "PLACE", "SETTING"]
UPLOAD_SUFFIXES = [".pdf", ".md", ".txt"]
MODES = ["paper", "novel"]
OCR_MODES = ["auto", "off", "force"]
TARGET_LANGUAGES = ["zh", "en", "ja", "ko", "fr", "de", "es", "pt", "ru", "ar"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MEDIA_TYPES = {".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".json": "application/json", ".jsonl": "application/x-ndjson", ".csv": "text/csv", ".pdf": "application/pdf", ".png": "image/png", ".zip": "application/zip"}
#: UUID namespace for names that are URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
USER_LEASES, TERM_BATCH_CHARS, ETA_EXTRA_S = 5, 12_000, 30
