"""Rule tables as data, in the order in which they are tried."""

from __future__ import annotations

# The watermark of scanned pages.
WATERMARK = r"(?i)CHINA\s+SOUTHERN\s+POWER\s+GRID(?:\s+CO\.?\s*,?\s*LTD\.?)?\s*"

# Regular expressions of the OCR cleaning, in order, with their replacements.
CLEANING_RULES = (
    (r"^\s*\$\\textcircled\{(\d+)\}\$\s*", "$1. "),
    (r"\$\\textcircled\{(\d+)\}\$", "($1)"),
    (r"(?<=\S)  \n", "\n"),
    (WATERMARK, ""),
    (r"^\s*[批★]\s*$\n", ""),
    (r"^\s*\d+\s*$\n", ""),
)

# LaTeX commands and the characters they stand for.
LATEX_SYMBOLS = {
    "\\star": "★", "\\bigstar": "★", "\\geqslant": "≥", "\\leqslant": "≤", "\\geq": "≥", "\\leq": "≤", "\\ge": "≥", "\\le": "≤",
    "\\times": "×", "\\pm": "±", "\\mp": "∓", "\\approx": "≈", "\\neq": "≠", "\\ne": "≠", "\\rightarrow": "→", "\\leftarrow": "←",
    "\\leftrightarrow": "↔", "\\Rightarrow": "⇒", "\\Leftarrow": "⇐", "\\uparrow": "↑", "\\downarrow": "↓", "\\infty": "∞",
    "\\degree": "°", "\\circ": "°", "\\alpha": "α", "\\beta": "β", "\\gamma": "γ", "\\delta": "δ", "\\epsilon": "ε", "\\theta": "θ",
    "\\lambda": "λ", "\\mu": "μ", "\\pi": "π", "\\sigma": "σ", "\\omega": "ω", "\\phi": "φ", "\\psi": "ψ", "\\rho": "ρ", "\\tau": "τ",
    "\\chi": "χ", "\\Delta": "Δ", "\\Sigma": "Σ", "\\Omega": "Ω", "\\Pi": "Π", "\\Phi": "Φ", "\\sqrt": "√", "\\cdot": "·",
    "\\bullet": "•", "\\div": "÷", "\\sim": "~", "\\propto": "∝", "\\perp": "⊥", "\\parallel": "∥", "\\subset": "⊂", "\\supset": "⊃",
    "\\subseteq": "⊆", "\\supseteq": "⊇", "\\in": "∈", "\\notin": "∉", "\\cup": "∪", "\\cap": "∩", "\\emptyset": "∅", "\\forall": "∀",
    "\\exists": "∃", "\\neg": "¬", "\\land": "∧", "\\lor": "∨", "\\triangle": "△", "\\square": "□", "\\boxdot": "☑", "\\checkmark": "✓",
}
# Commands that may be followed by a plain value.
LATEX_COMPARISONS = ("\\geqslant", "\\leqslant", "\\geq", "\\leq", "\\ge", "\\le", "\\approx", "\\neq", "\\ne")

# Openings and endings of model replies that are no part of the document.
PREAMBLES = (
    r"^\s*好的[，,。！!：:\s]*", r"^\s*以下是[^\n]*[：:\n]", r"^\s*当然[，,。！!：:\s]*", r"^\s*我来[^\n]*[：:\n]", r"^\s*为[您你][^\n]*[：:\n]",
    r"^\s*没问题[，,。！!：:\s]*", r"^\s*收到[，,。！!：:\s]*", r"^\s*明白[，,。！!：:\s]*", r"^\s*可以的?[，,。！!：:\s]*", r"^\s*让我[^\n]*[：:\n]",
    r"^\s*下面是[^\n]*[：:\n]", r"^\s*请看[^\n]*[：:\n]", r"^\s*处理完成[^\n]*[：:\n]", r"^\s*优化如下[^\n]*[：:\n]", r"^\s*Here is[^\n]*[:\n]",
    r"^\s*Sure[,!.:\s]*", r"^\s*I have[^\n]*[:\n]", r"^\s*The following[^\n]*[:\n]", r"^\s*Markdown\s*内容如下[：:\s]*",
)
SUFFIXES = (r"\n\s*以上是[^\n]*$", r"\n\s*希望[^\n]*$", r"\n\s*如[有需][^\n]*$", r"\n\s*处理完成[^\n]*$")
FORBIDDEN_OPENINGS = (
    r"^\s*好的[，,。！!：:\s]", r"^\s*以下是", r"^\s*当然[，,。！!：:\s]", r"^\s*我已为你", r"^\s*为您清洗", r"^\s*Here is the cleaned", r"^\s*Markdown\s*内容如下",
)
#: One of these is in every line that a forbidden opening or phrase fits.
OPENING_LITERALS = ("好的", "以下是", "当然", "我已为你", "为您清洗", "Here is the cleaned", "Markdown")
FORBIDDEN_PHRASES = ("好的", "我已为你", "为您清洗", "Here is the cleaned", "Markdown 内容如下")
MIN_LENGTH_RATIO = 0.5
CHUNK_SIZE = 2000

# The standard chapters with their rules: (id, name, exact, variant, patterns, exclusions).
CHAPTERS = (
    ("Ch1", "一、编制依据", ("编制依据",), ("编制说明", "编制目的", "编写依据"),
     (r"第[一二三四五六七八九十]+章\s*编制依据", r"第[一二三四五六七八九十]+章\s*编制说明"), ("编制单位", "编制人", "编制:", "编制：")),
    ("Ch2", "二、工程概况", ("工程概况",), ("工程概述", "工程简介", "项目概况", "工程地质"), (r"第[一二三四五六七八九十]+章\s*工程概",), ()),
    ("Ch3", "三、施工组织机构及职责", ("施工组织机构", "组织机构"),
     ("项目组织", "管理组织", "岗位职责", "管理人员", "管理机构", "施工管理及作业人员配备", "安健环施工管理组织机构"),
     (r"第[一二三四五六七八九十]+章\s*施工管理及",), ("质检部：", "其它成员：")),
    ("Ch4", "四、施工安排与进度计划", ("施工安排", "进度计划"), ("施工计划", "施工工期", "工期规划", "施工组织及", "施工工期计划", "工期计划"), (), ()),
    ("Ch5", "五、施工准备", ("施工准备",), ("准备工作", "资源配置", "劳动力", "设备计划", "材料供应", "技术准备", "人力资源"), (), ()),
    ("Ch6", "六、施工方法及工艺要求", ("施工方法", "施工工艺", "工艺要求"),
     ("施工技术", "施工措施", "主要工序", "施工方案概述", "施工工艺技术", "施工技术措施", "基础施工", "安装施工", "工艺流程"),
     (r"第[一二三四五六七八九十]+章\s*(施工工艺|灌注桩|基础施工)", r"第[一二三四五六七八九十]+章\s*施工$", r"第[一二三四五六七八九十]+章\s*复测及"), ()),
    ("Ch7", "七、质量管理与控制措施", ("质量管理", "质量控制"),
     ("质量工艺", "质量保证", "质量检验", "质量通病", "成品保护", "验收标准", "施工质量控制"),
     (r"第[一二三四五六七八九十]+章\s*验收", r"第[一二三四五六七八九十]+章\s*质量"), ()),
    ("Ch8", "八、安全文明施工管理", ("安全管理", "安全措施", "安全技术", "安全文明施工"),
     ("安全文明", "文明施工", "危险源", "安健环", "安全风险", "安全组织", "现场安全", "临时用电", "安全用电", "安全检查", "监测监控", "安全生产", "安全管理制度"),
     (r"第[一二三四五六七八九十]+章\s*(安全|施工保证)", r"第[一二三四五六七八九十]+章\s*安全文明"), ()),
    ("Ch9", "九、应急预案与处置措施", ("应急预案", "应急处置"), ("应急措施", "应急响应", "应急救援工作程序", "应急物资准备", "事故处置", "事故应急"),
     (r"第[一二三四五六七八九十]+章\s*应急",), ()),
    ("Ch10", "十、绿色施工与环境保护", ("绿色施工", "环境保护"),
     ("环保措施", "水土保护", "季节性施工", "环境因素", "绿色施工目标", "四节一环保", "绿色施工技术", "环境因素分析", "环境、水土保护"), (), ()),
)
GLOBAL_EXCLUSIONS = (
    "广东电网", "有限公司", "500kV", "新建工程", "kV.*变电站", "kV.*线路工程", "施工方案$", "施工组织设计$", "目录", "报审表", "报验表",
    "质检部：", "其它成员：", "编制：", "审核：", "批准：",
)
# Prefixes of titles; the section splitter knows the first three.
TITLE_PREFIXES = (r"第[一二三四五六七八九十百千]+章\s*", r"^[一二三四五六七八九十]+、\s*", r"^\d+(?:\.\d+)*\s+", r"^\(\d+\)\s*", r"^[①②③④⑤⑥⑦⑧⑨⑩]\s*")
SPLITTER_PREFIXES = TITLE_PREFIXES[:3]
# Digits of Chinese numerals.
CHINESE_DIGITS = {"一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "十": "10"}
# Words of forms, of their titles, and of covers.
ADMIN_KEYWORDS = ("报审", "报验", "盖章", "一式", "附件：", "附件:", "(签字)", "（签字）", "执业印章")
ADMIN_TITLES = ("目录", "报审表", "报验表")
COVER_MARKS = ("编写:", "编写：", "审核:", "审核：", "批准:", "批准：", "编制:", "编制：", "日期:", "日期：", "致：", "致:", "本表（含附件）", "本表(含附件)")

# Keywords that show the kind of work, and keywords for tags.
TYPE_KEYWORDS = (
    ("变电电气", ("主变", "GIS", "开关柜", "电缆", "接地装置", "避雷", "绝缘", "油务", "真空断路器")),
    ("变电土建", ("钢筋", "混凝土", "模板", "砌体", "基坑", "回填", "抹灰", "屋面", "防水")),
    ("线路塔基", ("灌注桩", "挖孔桩", "钻孔", "护筒", "钢筋笼", "铁塔", "杆塔", "线路")),
    ("设备安装", ("起重", "吊装", "钢丝绳", "卸扣", "配重", "就位", "吊车")),
    ("涂装工程", ("喷涂", "防腐", "防火涂料", "底漆", "面漆", "锌", "油漆")),
    ("地基处理", ("强夯", "地基", "夯击", "填土", "承载力")),
)
TAG_KEYWORDS = (
    "混凝土", "钢筋", "模板", "浇筑", "振捣", "养护", "拆模", "基坑", "回填", "砌体", "抹灰", "防水", "屋面", "装饰",
    "主变", "GIS", "开关柜", "电缆", "接地", "调试", "绝缘", "油务", "避雷器", "互感器", "真空断路器",
    "灌注桩", "挖孔桩", "钻孔", "护筒", "清孔", "钢筋笼", "桩基", "起重", "吊装", "钢丝绳", "卸扣", "吊车", "就位",
    "危险源", "安全带", "防护栏", "安全网", "监护", "临时用电", "高处作业", "有限空间", "交叉作业",
    "验收", "检验", "合格率", "偏差", "保护层", "垂直度", "强夯", "夯击", "喷涂", "防腐", "防火涂料",
    "触电", "坍塌", "高处坠落", "物体打击", "火灾", "中毒", "节水", "节材", "节地", "扬尘", "噪音", "废弃物",
)
# Kind and quality of the numbered source documents, priority of the chapters.
DOC_TYPES = {1: "线路塔基", 2: "涂装工程", 3: "涂装工程", 4: "变电土建", 5: "绿色施工", 6: "变电土建", 7: "变电电气", 8: "专题方案", 9: "变电土建", 10: "设备安装", 11: "地基处理", 12: "线路塔基", 15: "线路塔基", 16: "专题方案"}
DOC_QUALITY = {1: 2, 2: 2, 3: 1, 4: 3, 5: 2, 6: 3, 7: 3, 8: 2, 9: 2, 10: 3, 11: 3, 12: 3, 15: 2, 16: 2}
UNKNOWN_TYPE, UNKNOWN_QUALITY = "未知", 2
PRIORITIES = {"Ch1": "P0", "Ch6": "P0", "Ch7": "P1", "Ch8": "P1", "Ch3": "P2", "Ch9": "P2", "Ch2": "P3", "Ch4": "P3", "Ch5": "P3", "Ch10": "P3"}
REFINE_MIN_CHARS = 30
#: Broad words that may map a short title wrongly.
BROAD_WORDS = ("施工", "质量", "安全", "应急", "概述")
# Words of headers that are no chapters, and the numbering before a chapter's name.
NO_CHAPTER_WORDS = ("目录", "表", "图", "附件", "gis", "500kv", "电白", "广东电网", "中国南方电网")
CHAPTER_NUMBERING = (r"^[一二三四五六七八九十\d]+[、\.\s]", r"^\d+(\.\d+)*\s*")
# The rules that hold where no rule base is there: (id, exact, variant).
FALLBACK_RULES = (
    ("Ch1", ("编制依据",), ("编制说明", "编制目的", "编写依据")),
    ("Ch2", ("工程概况",), ("工程概述", "工程简介", "项目概况", "工程地质")),
    ("Ch3", ("施工组织机构", "组织机构"), ("项目组织", "管理组织", "岗位职责", "管理人员", "管理机构")),
    ("Ch4", ("施工安排", "进度计划"), ("施工计划", "施工工期", "工期规划", "施工组织及")),
    ("Ch5", ("施工准备",), ("准备工作", "资源配置", "劳动力", "设备计划", "材料供应")),
    ("Ch6", ("施工方法", "施工工艺", "工艺要求"), ("施工技术", "施工措施", "主要工序", "施工方案概述", "施工工艺技术", "施工技术措施", "基础施工", "安装施工")),
    ("Ch7", ("质量管理", "质量控制"), ("质量工艺", "质量保证", "质量检验", "质量通病", "成品保护")),
    ("Ch8", ("安全管理", "安全措施", "安全技术"), ("安全文明", "文明施工", "危险源", "安健环", "安全风险", "安全组织", "现场安全", "临时用电", "安全用电")),
    ("Ch9", ("应急预案", "应急处置"), ("应急措施", "应急响应")),
    ("Ch10", ("绿色施工", "环境保护"), ("环保措施", "水土保护", "季节性施工", "环境因素")),
)

# Chapters to collections, and what retrieval needs.
COLLECTIONS = {
    "一、编制依据": "ch01_basis", "六、施工方法及工艺要求": "ch06_methods", "七、质量管理与控制措施": "ch07_quality", "八、安全文明施工管理": "ch08_safety",
    "九、应急预案与处置措施": "ch09_emergency", "十、绿色施工与环境保护": "ch10_green", "五、施工准备": "equipment", "二、工程概况": "templates",
    "三、施工组织机构及职责": "templates", "四、施工安排与进度计划": "templates",
}
ALL_COLLECTIONS = ("ch01_basis", "ch06_methods", "ch07_quality", "ch08_safety", "ch09_emergency", "ch10_green", "equipment", "templates")
GRAPH_CHAPTERS = ("ch07_quality", "ch08_safety", "ch09_emergency")
TEMPLATE_COLLECTION = "templates"
TOP_K, SCORE_THRESHOLD = 3, 0.6
# Labels of the metadata before an indexed text, of a description, and a reranker's instruction.
MARKERS = {"type": "工程类型", "section": "章节", "tags": "标签"}
DESCRIPTION = {"type": "工程类型", "attributes": "属性", "aliases": "别名", "source": "来源", "confidence": "置信度"}
RERANK_INSTRUCTION = "给定一个施工方案相关的检索查询，判断文档是否与查询相关"

# Entities and relations.
ENTITY_LABELS = {"process": "施工工序", "equipment": "施工设备", "hazard": "危险源", "safety_measure": "安全措施", "quality_point": "质量控制要点"}
RELATION_KEYWORDS = {
    "requires_equipment": "需要设备,工序设备", "produces_hazard": "产生危险源,工序危险", "mitigated_by": "安全措施,控制措施,风险缓解", "requires_quality_check": "质量控制,质量要点,质量检查",
}
TYPE_ABBREVIATIONS = {"变电土建": "civil", "变电电气": "elec", "线路塔基": "line", "特殊作业": "special", "地基处理": "found", "设备安装": "install", "涂装工程": "coat", "专题方案": "topic", "绿色施工": "green", "通用": "common"}
# Fillers at the ends of names.
NAME_PREFIXES = ("进行", "实施", "开展")
NAME_SUFFIXES = ("作业", "工作", "工程", "施工", "的", "等")
COMMON_TYPE = "通用"
# What the numbered sections of the rule documents are about, and words for equipment.
HAZARD_SECTIONS = {"2": "变电土建", "3": "变电电气", "4": "线路塔基", "5": "特殊作业"}
QUALITY_SECTIONS = {"2": "变电土建", "3": "变电土建", "4": "变电电气", "4.1": "变电电气", "4.2": "变电电气", "5": "线路塔基", "6": "特殊作业", "6.1": "特殊作业", "6.2": "特殊作业"}
EQUIPMENT_KEYWORDS = ("机", "器", "锤", "棒", "泵", "仪", "架", "管", "锯", "车", "模板", "串筒", "溜槽", "卷扬", "钢丝绳", "吊具", "脚手架")
NO_PROCESS_WORDS = ("参数", "标准", "指标", "要求", "措施", "规格")
REFERENCE_TYPES = {"civil_works.md": "变电土建", "electrical_install.md": "变电电气", "line_tower.md": "线路塔基", "special_general.md": "特殊作业"}
FUZZY_DISTANCE, SOURCE_BOOST = 2, 0.1

# Titles of the generated chapters.
CHAPTER_TITLES = {1: "编制依据", 2: "工程概况", 3: "施工组织机构及职责", 4: "施工安排与进度计划", 5: "施工准备", 6: "施工方法及工艺要求", 7: "质量管理与控制措施", 8: "安全文明施工管理", 9: "应急预案与处置措施"}
CHINESE_NUMBERS = ("一", "二", "三", "四", "五", "六", "七", "八", "九")
PROJECT_PLACEHOLDERS = ("{{工程名称}}", "【工程名称】", "{工程名称}")
#: Tokens that the model may write for a chapter.
MAX_TOKENS = {1: 2048, 2: 2048, 3: 3072, 4: 3072, 5: 3072, 6: 6144, 7: 4096, 8: 5120, 9: 4096}
