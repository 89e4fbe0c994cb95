"""Word lists and patterns of the operators. Every operator takes its lists as parameters; these are the defaults."""

# Fixed values.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "must", "and", "or", "but",
    "if", "then", "than", "that", "this", "it", "its", "in", "on", "at",
    "to", "for", "of", "with", "by", "from", "as", "into", "about",
    "not", "no", "so", "up", "out", "all", "also", "very", "just", "how",
)
PAPER_HINTS = ("abstract", "introduction", "methodology", "experiment", "conclusion", "references", "appendix", "theorem", "proof")
TECHNICAL_HINTS = ("architecture", "service", "module", "api", "endpoint", "config", "deployment", "pipeline", "class", "function", "component")
MEDICAL_HINTS = (
    "diagnosis", "diagnostic", "disease", "symptom", "sign", "treatment",
    "therapy", "drug", "medication", "dose", "adverse", "prognosis", "risk",
    "complication", "biomarker", "laboratory", "test", "screening", "imaging",
    "procedure", "syndrome", "infection", "cancer", "tumor", "mutation",
    "patient", "clinical", "患者", "症状", "体征", "诊断", "治疗", "药物",
    "剂量", "并发症", "预后", "风险", "检查", "检验", "影像", "手术", "感染",
    "肿瘤", "癌", "综合征", "生物标志物",
)
COMMON_ENTITY_NAMES = (
    "patient", "patients", "treatment", "treatments", "method", "methods", "result", "results", "study", "studies",
    "data", "analysis", "conclusion", "conclusions", "患者", "治疗", "方法", "结果", "研究", "数据", "分析", "结论", "目的",
)
NEGATION_TRIGGERS = ("无", "未见", "否认", "排除", "不考虑", "没有", "未发现", "阴性", "negative for", "no evidence of", "without", "denies")
ASSERTION_CUES = {
    "negated": ("未见", "未发现", "未提示", "未触及", "无", "否认", "排除", "没有", "阴性", "不支持", "不考虑"),
    "speculated": ("不能排除", "不除外", "疑似", "考虑", "可能", "待排", "倾向于", "拟诊"),
    "conditional": ("如果", "若", "当", "满足", "出现", "时", "则", "禁用", "慎用"),
    "historical": ("既往", "病史", "曾患", "曾因", "术后", "既往诊断", "既往使用"),
    "family_history": ("家族史", "父亲", "母亲", "兄弟", "姐妹", "一级亲属", "遗传史"),
}
PROHIBITIONS = ("禁用", "不可使用", "不可以用", "不能使用")
MEASUREMENT_CUES = ("剂量", "用量", "用法", "需要注意", "频次", "频率", "每日", "每天", "每周", "发生率", "阈值", "标准", "时间", "持续")
CHANNEL_PRIORITY = ("vector", "bm25", "graph")

# Lists of our own for texts without medical vocabulary.
PLAIN_CUES = {
    "negated": ("not", "nicht", "no", "pas"),
    "speculated": ("or", "ou", "may"),
    "conditional": ("for", "für", "por", "pour"),
    "historical": ("was", "war", "était"),
    "family_history": ("from", "von", "del"),
}
