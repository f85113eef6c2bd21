"""Word lists and codes that results depend on."""

# Fixed values, in natural order.
CRITICAL = ["暴跌", "崩盘", "停牌", "退市", "破产", "熔断"]
HIGH = ["大跌", "跌停", "利空", "罚款", "调查", "诉讼", "违约"]
MEDIUM = ["利好", "大涨", "涨停", "突破", "新高"]
LOW = ["回购", "增持", "重组", "分红"]
SEVERITY_WORDS = {"critical": CRITICAL, "high": HIGH, "medium": MEDIUM, "low": LOW}
CORPORATE_SUFFIXES = ["ltd", "ltd.", "limited", "inc", "inc.", "corp", "corp.", "co", "co.", "plc", "llc", "lp", "sa", "ag", "se", "holdings", "holding", "group", "控股", "有限公司", "股份有限公司", "集团", "公司"]
COUNTRIES = ["United States", "China", "European Union", "Japan", "Russia", "India", "UK", "Germany", "France", "Brazil", "Canada", "Australia", "South Korea"]
COMMODITIES = {"Crude Oil": r"\b(?:crude\s+)?oil\b", "Gold": r"\bgold\b", "Silver": r"\bsilver\b", "Copper": r"\bcopper\b", "Natural Gas": r"\bnatural\s+gas\b", "Wheat": r"\bwheat\b", "Corn": r"\bcorn\b", "Soybeans": r"\bsoybean\b"}
THEMES = {"Inflation": r"\binflation\b", "Interest Rates": r"\binterest\s+rate\b", "GDP Growth": r"\bGDP\b", "Unemployment": r"\bunemployment\b", "Recession": r"\brecession\b", "Tariffs": r"\btariff\b", "Trade War": r"\btrade\s+war\b", "Sanctions": r"\bsanction\b", "IPO": r"\bIPO\b", "M&A": r"\bmerger\b"}
STOP_WORDS = [
    "the", "a", "an", "and", "or", "is", "are", "was", "were", "in", "on", "at", "for", "to", "of", "with", "by", "from", "as", "it", "its", "this",
    "that", "not", "but", "has", "have", "had", "be", "been", "being", "will", "can", "may", "could", "should", "would", "do", "does", "did", "if",
    "than", "then", "so", "no", "up", "out", "about", "into", "over", "after", "more", "most", "some", "any", "all", "each", "every", "new", "also",
    "how", "why", "what", "when", "where", "which", "who", "whom", "their", "our", "your", "his", "her", "we", "they", "you", "he", "she", "i", "me",
    "my", "us", "them", "s", "t", "re", "ve", "ll", "d", "m"
]
MACRO_THEMES = [
    "Econ Centralbank", "Econ Interest Rates", "MONETARY_POLICY", "Econ Inflation", "Econ Deflation", "RECESSION", "GDP", "Econ Freetrade", "TARIFF", "SANCTION", "EMBARGO", "BLOCKADE",
    "GEOPOLITICAL", "WAR", "ARMEDCONFLICT", "CEASEFIRE", "REGULATION", "ANTITRUST", "Econ Stockmarket", "Econ Currency Exchange Rate", "Econ Bitcoin", "Econ Goldprice", "Econ Oilprice",
    "SEMICONDUCTOR", "ENERGY", "Econ Dieselprice", "Econ Gasolineprice", "Econ Debt", "Econ Budget Deficit", "Econ Bankruptcy",
]
LABELS = {"SECTOR": "sector", "STOCK": "stock", "COUNTRY": "country", "POLICY": "policy", "TOPIC": "topic", "ORGANIZATION": "organization", "EVENT": "event", "PERSON": "person"}
LEAK_MARKERS = [r"\[END OF CONTENT\]", "ENTITY RESOLUTION RULES", "CANONICAL ENTITY NAMES", "ENTITY NAME LANGUAGE RULE", "Use the canonical names listed below", "Do NOT add or remove suffixes", r"Please wait,?\s*We are optimizing your request", r"\(Wait, let.s refine", "Policy Check - Updated from Messages", "Policy/Act”"]
TENORS = ["1mo", "2mo", "3mo", "4mo", "6mo", "1yr", "2yr", "3yr", "5yr", "7yr", "10yr", "20yr", "30yr"]
STATUSES = ["pending", "processing", "done", "skipped", "failed", "dead"]
TTL_DAYS = {"SYMBOL": 3, "SECTOR": 7, "MACRO": 14}

# Fixed values. Relation names: prefixes of a raw name and the core type they stand for, first match wins.
EDGE_PREFIXES = [
    ("RELATES_TO", ["RELATES_TO"]),
    ("TRIGGERS", ["CAUSES", "CAUSED", "TRIGGER", "LED_TO", "SPARK", "RESULT"]),
    ("AFFECTS", ["AFFECTS", "IMPACTS", "INFLUENC", "MITIGATES"]),
    ("INVOLVES", ["INVOLV", "ACTOR", "CEO", "EMPLOYED", "WORKS_FOR", "CHAIR", "PRESIDENT"]),
    ("PART_OF", ["SUBSIDIARY", "OWNED_BY", "PARENT_OF", "ACQUIRED"]),
    ("HAPPENED_IN", ["IN_", "HAPPENED"]),
    ("BELONGS_TO", ["BELONGS"]),
    ("TRADED_ON", ["TRADED", "LISTED"]),
    ("PART_OF", ["PART", "LOCATED"]),
]

# Fixed values. Facts: patterns of each core type, families in order, first match wins.
_ROLES = r"ceo|chief\s+executive|chairman|chairwoman|chair(?:person)?|president|chief|head|directors?|ministers?|governors?|premiers?|secretary|spokespersons?|founders?|owners?|partners?|analysts?|economists?|professors?|strategists?|fellows?|anchors?|experts?"
FACT_PATTERNS = [
    ("PART_OF", [
        r"\bsubsidiar(?:y|ies)\b", r"\bparent\s+(company|firm|group)\b", r"\bowned\s+by\b", r"\bowns\s+the\b", r"\bwholly[- ]?owned\b", r"\ba\s+unit\s+of\b",
        r"\b(?:is|are|was|were|forms?|constitutes?|remains?)\s+(?:an?\s+)?(?:integral\s+|key\s+|major\s+|core\s+|vital\s+|attractive\s+)?part\s+of\b(?!\s+(?:the\s+|an?\s+)?(?:[\w'-]+\s+){0,2}?(?:races?|efforts?|push|drive|campaigns?|battles?|fights?|contests?|debates?|journeys?|trends?|waves?|movements?|problems?|solutions?|plans?|deals?|strateg(?:y|ies)|initiatives?|process(?:es)?|agendas?|packages?|discussions?)\b)",
        r"\bacquired\b", r"\bowns\b", r"\braised\s+its\s+stake\b", r"\bholds?\s+a\s+stake\b",
    ]),
    ("INVOLVES", [
        r"\binvolv(es|ed|ing)?\b", r"\bceo\b", r"\bchief\b", r"chairman|chairwoman|\bco-?chairs?\b|\bchair\b", r"\bpresident\b", r"\bdirectors?\b", r"\banalysts?\b", r"\beconomists?\b", r"\bprofessors?\b", r"\bfounders?\b", r"\bjoined\b",
        r"\bbecame\s+(the\s+)?(?:world'?s\s+)?(?:" + _ROLES + r")\b", r"\bappoint(ed|ment)?\b", r"\bministers?\b", r"\bsecretary\b", r"\bgovernors?\b", r"\bpremiers?\b", r"\bspokespersons?\b", r"\bemployed\b", r"\bworks?\s+for\b", r"\bhead\s+of\b", r"\bfellows?\b",
        r"\bpartnership\b|\bpartners?\s+(at|of|in)\b", r"\bowners?\b", r"\bserv(es|ed)\s+as\b", r"\bstrategists?\b", r"\banchors?\b", r"\bexperts?\b", r"\bleadership\s+roles?\b", r"\bmayor\b", r"\bambassadors?\b",
    ]),
    ("AFFECTS", [
        r"\bthreatens?\b", r"\bboosts?\b", r"\bpressures?\b", r"\bimpacts?\b(?!\s+(of|on)\b)", r"\bundermines?\b", r"\bhurts?\b", r"\bbenefits?\b", r"\bsupports?\b(?!\s+(of|for|by|to|in|on|at|during|from)\b)",
        r"\bopposes?\b", r"\bwithdrew\s+(its\s+)?support\b", r"\bharms?\b", r"\bdamages?\b", r"\bstrengthens?\b", r"\bweakens?\b",
    ]),
    ("TRIGGERS", [r"\bcaused\b", r"\bled\s+to\b", r"\btriggered?\b", r"\bsparked?\b", r"\bresulted\s+in\b", r"\bprecipitated?\b"]),
    ("HAPPENED_IN", [r"\bhappened\s+in\b", r"\boccurred\s+in\b", r"\btook\s+place\s+in\b", r"\bis\s+located\s+in\b", r"\bwas\s+located\s+in\b"]),
]

# What edges were once called, by pattern, and of a family's other patterns; loose words, retired names.
LEGACY = {
    r"\bsubsidiar(?:y|ies)\b": "SUBSIDIARY_OF",
    r"\bparent\s+(company|firm|group)\b": "PARENT_OF",
    r"\ba\s+unit\s+of\b": "SUBSIDIARY_OF",
    r"\bacquired\b": "ACQUIRED_BY",
    r"\binvolv(es|ed|ing)?\b": "INVOLVES",
    r"chairman|chairwoman|\bco-?chairs?\b|\bchair\b": "CHAIRMAN_OF",
    r"\bjoined\b": "EMPLOYED_BY",
    r"\bemployed\b": "EMPLOYED_BY",
    r"\bworks?\s+for\b": "WORKS_FOR",
} | {p: "PART_OF" for p in FACT_PATTERNS[0][1] if "part\\s+of" in p}
LEGACY_DEFAULTS = {"PART_OF": "OWNED_BY", "INVOLVES": "CEO_OF"}
LOOSE_FACT = r"\bbecame\b|\bpartners?\b"
RETIRED = ["INVESTS_IN", "EXPOSED_TO"]

# Names of media that are no entities.
MEDIA = ["CLS", "Cailisi", "CLS News", "Reuters", "Bloomberg", "Xinhua", "CCTV", "Eastmoney", "财联社", "新华社", "央视", "路透社", "彭博社"]

# Hosts whose news counts whatever its theme.
MEDIA_HOSTS = [
    "reuters.com", "bloomberg.com", "apnews.com", "afp.com", "bbc.com", "bbc.co.uk", "wsj.com", "ft.com", "economist.com", "cnbc.com", "marketwatch.com", "barrons.com",
    "investing.com", "finance.yahoo.com", "federalreserve.gov", "ecb.europa.eu", "imf.org", "worldbank.org", "bis.org", "oecd.org", "bankofengland.co.uk", "boj.or.jp", "pbc.gov.cn",
    "scmp.com", "nikkei.com", "channelnewsasia.com", "businesstimes.com.sg", "straitstimes.com", "theedgemalaysia.com", "caixin.com", "cls.cn", "yicai.com", "21jingji.com", "stcn.com",
]

# Words that make a feed item matter.
FEED_WORDS = [
    "fed", "ecb", "rate", "inflation", "gdp", "oil", "gold", "copper", "tariff", "trade", "market", "stock", "bond", "forex", "currency", "central bank", "monetary policy",
    "interest rate", "treasury", "commodity", "crude", "natural gas", "silver", "platinum", "geopolitical", "sanction", "embargo", "war", "conflict", "earnings", "revenue",
    "profit", "loss", "ipo", "merger", "acquisition", "recession", "growth", "employment", "unemployment", "cpi", "ppi", "gaza", "israel", "ukraine", "taiwan",
    "south china sea", "red sea", "iran", "russia", "nato", "summit", "fiscal", "deficit", "debt", "budget", "stimulus", "quantitative easing", "austerity", "supply chain",
    "semiconductor", "chip", "shipping", "logistics", "rare earth", "ceo", "layoff", "restructuring", "bankruptcy", "dividend", "buyback", "crisis", "default", "contagion",
    "volatility", "correction", "renewable", "solar", "ev", "battery", "lithium", "carbon", "business", "economy", "industry", "company", "corporate", "investment", "bank",
    "finance", "export", "import", "manufacturing", "technology", "energy", "infrastructure", "央行", "利率", "通胀", "关税", "贸易", "股市", "债券", "汇率", "原油", "黄金",
    "白银", "铜", "天然气", "大宗商品", "地缘政治", "制裁", "禁运", "战争", "冲突", "财报", "营收", "利润", "亏损", "ipo", "并购", "收购", "衰退", "增长", "就业", "失业", "cpi", "ppi",
]

# Names of theme prefixes.
THEME_PREFIXES = {
    "WB_": "World Bank",
    "TAX_": "Taxonomy",
    "EPU_": "Economic Policy Uncertainty",
    "CRISISLEX_": "CrisisLex",
    "SOC_": "Social",
    "UNGP_": "UN Guiding Principles",
    "USPEC_": "US Political/Economic",
    "GENERAL_": "General",
    "MEDIA_": "Media",
    "MANMADE_DISASTER": "Manmade Disaster",
}

# Fixed values of the yield curve's text: terms in order, the spread's name, a sentence for each shape.
CURVE_TERMS = {
    "1mo": "1个月期", "3mo": "3个月期", "6mo": "6个月期", "1yr": "1年期", "2yr": "2年期", "3yr": "3年期", "5yr": "5年期", "7yr": "7年期", "10yr": "10年期",
    "20yr": "20年期", "30yr": "30年期",
}
CURVE_LISTED = ["3mo", "6mo", "1yr", "2yr", "3yr", "5yr", "7yr", "10yr", "20yr", "30yr"]
CURVE_SPREAD = "2s10s利差"
CURVE_SHAPES = {"normal": "收益率曲线形态正常，无倒挂风险信号。", "flat": "收益率曲线形态趋平，接近倒挂区间。", "inverted": "收益率曲线形态倒挂，倒挂是衰退预警信号。"}

# Fixed values of China's series: name, unit and meaning where told as a sentence; name, unit and frequency where listed.
CHINA_TOLD = {
    "gdp": ("GDP（国内生产总值）", "亿元", "衡量中国经济总体规模的核心指标"),
    "cpi": ("CPI（居民消费价格指数）", "%", "衡量通胀水平的核心指标"),
    "ppi": ("PPI（工业生产者出厂价格指数）", "%", "衡量工业品价格变化，反映上游成本压力"),
    "pmi": ("PMI（官方制造业采购经理指数）", "", "50以上为扩张区间，以下为收缩区间"),
    "caixin_pmi": ("PMI（财新制造业采购经理指数）", "", "偏向中小企业，与官方PMI互为补充"),
}
CHINA_LISTED = {
    "gdp": ("GDP", "亿元", "quarterly"),
    "cpi": ("CPI", "%", "monthly"),
    "ppi": ("PPI", "%", "monthly"),
    "pmi": ("PMI (Official Manufacturing)", "", "monthly"),
    "caixin_pmi": ("PMI (Caixin Manufacturing)", "", "monthly"),
}
