"""Vocabularies, patterns and thresholds that define the results.

Everything here is plain data. Larger, deployment-specific lists (company to
industry overrides, watch lists of companies, wide synonym vocabularies) are
read from JSON by ``vacancylake.sources.dims``.
"""

# --- URL canonicalisation -------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = [
    "spm", "scm", "bd_vid", "gclid", "fbclid", "msclkid", "yclid",
    "hmsr", "hmpl", "hmcu", "hmkw", "hmci", "_ga", "gio_link_id",
]

# --- thresholds -----------------------------------------------------------
MIN_SUMMARY_CHARS = 60
ABSENCE_MIN_ACTIVE = 8
ABSENCE_MAX_RATIO = 0.5

# --- city aliases, in match order ----------------------------------------
CITY_ALIASES = [
    ("北京", "北京"), ("北京市", "北京"), ("beijing", "北京"),
    ("上海", "上海"), ("上海市", "上海"), ("shanghai", "上海"),
    ("深圳", "深圳"), ("深圳市", "深圳"), ("shenzhen", "深圳"),
    ("广州", "广州"), ("广州市", "广州"), ("guangzhou", "广州"),
    ("杭州", "杭州"), ("杭州市", "杭州"), ("hangzhou", "杭州"),
    ("南京", "南京"), ("南京市", "南京"), ("nanjing", "南京"),
    ("苏州", "苏州"), ("苏州市", "苏州"), ("suzhou", "苏州"),
    ("成都", "成都"), ("成都市", "成都"), ("chengdu", "成都"),
    ("武汉", "武汉"), ("武汉市", "武汉"), ("wuhan", "武汉"),
    ("西安", "西安"), ("西安市", "西安"), ("xi'an", "西安"), ("xian", "西安"),
    ("香港", "香港"), ("香港特别行政区", "香港"), ("hong kong", "香港"),
    ("新加坡", "新加坡"), ("singapore", "新加坡"),
]
NATIONWIDE_ALIASES = [("全国", "全国"), ("全国多地", "全国"), ("多地", "全国")]
REMOTE_ALIASES = [("远程", "远程"), ("remote", "远程")]
OVERSEAS_CITY_ALIASES = [
    ("纽约", "纽约"), ("new york", "纽约"), ("nyc", "纽约"),
    ("旧金山", "旧金山"), ("san francisco", "旧金山"), ("sf", "旧金山"),
    ("西雅图", "西雅图"), ("seattle", "西雅图"),
    ("山景城", "山景城"), ("mountain view", "山景城"),
    ("桑尼维尔", "桑尼维尔"), ("sunnyvale", "桑尼维尔"),
    ("圣何塞", "圣何塞"), ("san jose", "圣何塞"),
    ("奥斯汀", "奥斯汀"), ("austin", "奥斯汀"),
    ("波士顿", "波士顿"), ("boston", "波士顿"),
    ("伦敦", "伦敦"), ("london", "伦敦"),
]
BLANK_LOCATIONS = ["unknown", "multiple locations", "various", ""]

# --- geography ------------------------------------------------------------
CHINA_LATIN = [
    "china", "prc", "greater china",
    "beijing", "shanghai", "shenzhen", "guangzhou", "hangzhou", "chengdu",
    "nanjing", "suzhou", "wuhan", "xi'an", "xian", "foshan", "dongguan",
    "tianjin", "chongqing", "wuxi", "ningbo", "qingdao", "dalian", "xiamen",
    "hefei", "changsha", "zhengzhou", "jinan", "kunming", "shijiazhuang",
    "changchun", "harbin", "shenyang", "nanchang", "fuzhou", "nanning",
    "guiyang", "lanzhou", "taiyuan", "wenzhou", "zhuhai", "yantai", "xuzhou",
    "changzhou", "nantong", "weifang", "luoyang", "huizhou",
    "jiangsu", "zhejiang", "guangdong", "sichuan", "shandong", "henan",
    "hebei", "hunan", "hubei", "anhui", "fujian", "jiangxi", "liaoning",
    "shaanxi", "shanxi", "yunnan", "guizhou", "gansu", "hainan", "jilin",
    "heilongjiang", "qinghai", "ningxia", "xinjiang", "guangxi",
    "nei mongol", "inner mongolia",
]
CHINA_CJK = [
    "中国", "北京", "上海", "深圳", "广州", "杭州", "成都", "南京", "苏州", "武汉",
    "西安", "佛山", "天津", "重庆", "无锡", "宁波", "青岛", "大连", "厦门", "合肥",
    "长沙", "郑州",
]
HK_TOKENS = ["hong kong", "香港", "hongkong"]
MO_TOKENS = ["macau", "macao", "澳门"]
TW_TOKENS = ["taiwan", "台湾", "臺灣", "taipei", "台北", "臺北", "kaohsiung", "高雄",
             "hsinchu", "新竹"]
US_TOKENS = [
    "united states", "usa", "u.s.", "u.s.a", "america", "us",
    "new york", "纽约", "san francisco", "旧金山", "sf bay", "bay area",
    "seattle", "西雅图", "sunnyvale", "mountain view", "cupertino", "san jose",
    "santa clara", "palo alto", "austin", "boston", "chicago", "los angeles",
    "washington", "atlanta", "denver", "dallas", "houston", "san diego",
    "redmond", "menlo park", ", ca", ", ny", ", wa", ", tx", ", ma",
]
SG_TOKENS = ["singapore", "sg", "新加坡"]
GREATER_CHINA = ["CN", "HK", "MO"]
REMOTE_MARKERS = ["remote", "anywhere", "distributed", "work from home", "wfh", "远程", "远端"]
OVERSEAS_WORDS = [
    "usa", "us", "canada", "uk", "britain", "ireland", "germany", "france", "netherlands",
    "spain", "italy", "poland", "portugal", "sweden", "switzerland", "austria", "belgium",
    "europe", "emea", "americas", "latam", "brazil", "mexico", "argentina", "colombia",
    "india", "japan", "korea", "singapore", "malaysia", "thailand", "vietnam", "indonesia",
    "philippines", "australia", "nz", "uae", "dubai", "israel", "egypt", "turkey", "africa",
]
OVERSEAS_PHRASES = [
    "united states", "united kingdom", "new zealand", "south korea", "saudi arabia",
    "sri lanka", "costa rica", "south africa",
]
COMPANY_API_FOREIGN = [
    "台湾", "台北", "高雄", "新加坡", "日本", "东京", "大阪", "韩国", "首尔",
    "美国", "纽约", "洛杉矶", "西雅图", "加拿大", "多伦多", "温哥华",
    "英国", "伦敦", "法国", "巴黎", "德国", "柏林", "澳大利亚", "悉尼", "墨尔本",
    "巴西", "圣保罗", "沙特", "利雅得", "阿联酋", "迪拜", "科威特", "卡塔尔", "巴林", "阿曼",
    "越南", "胡志明", "印度", "班加罗尔",
]
COMPANY_API_CITIES = ["沈阳", "东莞", "长春", "珠海", "嘉兴", "济南", "芜湖",
                      "烟台", "淮安", "铜仁", "吉首", "澄迈", "雄安", "湛江"]
ADMIN_SUFFIXES = ["省", "市", "自治区", "特别行政区", "自治州", "地区", "盟", "新区"]
REGION_ALIASES = {
    "us": "US", "usa": "US", "united states": "US", "美国": "US",
    "sg": "SG", "singapore": "SG", "新加坡": "SG",
    "remote": "Remote", "global": "Remote", "全球远程": "Remote", "远程": "Remote",
}
DEFAULT_OVERSEAS_REGIONS = ["US", "SG", "Remote"]
# places that may stand in front of a brand inside a legal entity name
PLACE_PREFIXES = (
    "北京 上海 天津 重庆 广东 广州 深圳 珠海 佛山 东莞 中山 惠州 汕头 江苏 南京 苏州 无锡 常州 南通 徐州 "
    "浙江 杭州 宁波 温州 绍兴 嘉兴 金华 台州 山东 济南 青岛 烟台 潍坊 临沂 淄博 河北 石家庄 唐山 保定 "
    "河南 郑州 洛阳 湖北 武汉 宜昌 襄阳 湖南 长沙 株洲 四川 成都 绵阳 陕西 西安 辽宁 沈阳 大连 "
    "吉林 长春 黑龙江 哈尔滨 安徽 合肥 芜湖 福建 厦门 福州 泉州 江西 南昌 山西 太原 云南 昆明 "
    "贵州 贵阳 广西 南宁 柳州 海南 三亚 海口 甘肃 兰州 新疆 乌鲁木齐 内蒙古 呼和浩特 包头 "
    "宁夏 银川 青海 西宁 西藏 拉萨 香港 澳门 中国 华北 华东 华南 华中 西南 西北 东北"
).split()
PLACE_PREFIX_SUFFIXES = ["省", "市", "自治区", "特别行政区"]

# --- recruitment wording --------------------------------------------------
RECRUIT_TYPE_WORDS = [
    "实习", "intern", "校招", "校园招聘", "应届", "管培", "管理培训生", "留学生", "毕业生",
    "社招", "社会招聘", "社会招募", "campus", "new grad", "graduate program",
    "experienced", "professional", "研究岗", "投研",
]
# job type from title and summary, first match wins
JOB_TYPE_RULES = [
    ("暑期实习", r"暑期实习|summer(?:\s+\d{4})?\s+intern(?:ship)?s?\b"),
    ("日常实习", r"日常实习|daily intern|off-cycle intern"),
    ("管培生", r"管培生|管理培训生|graduate program|management trainee"),
    ("留学生专项", r"留学生|海外学生|overseas student|returnee"),
    ("校招", r"校招|校园招聘|应届|new grad"),
    ("校招", r"\b(?:university\s+graduate|entry[-\s]?level)\b"),
    ("实习", r"实习|intern"),
    ("研究岗", r"投研|研究员|研究岗|行业研究|股票研究|equity research|investment research"),
    ("兼职", r"兼职|part time|part-time"),
    ("社招", r"社招|社会招聘|experienced|professional"),
    ("社招", r"\b(?:senior|staff|principal|lead|distinguished)\b"),
    ("全职", r"全职"),
]
# field-level normalisation over title, source type, url and summary
JOB_TYPE_FIELD_RULES = [
    ("暑期实习", r"暑期实习|summer(?:\s+[0-9]{4})?\s+intern(?:ship)?s?\b"),
    ("日常实习", r"日常实习|daily\s+intern(?:ship)?s?\b|off-?cycle\s+intern(?:ship)?s?\b"),
    ("管培生", r"管培生|管理培训生|graduate\s+program|management\s+trainee"),
    ("留学生专项", r"留学生|海外学生|overseas student|returnee"),
    ("实习", r"实习|\bintern(?:ship)?s?\b|shixi"),
    ("校招", r"校招|校园招聘|应届|[0-9]{2,4}届|campus|new\s+grads?\b|university\s+graduate|entry[-\s]?level|xiaozhao"),
    ("研究岗", r"投研|研究员|研究岗|行业研究|股票研究|equity research|investment research"),
    ("兼职", r"兼职|part time|part-time"),
    ("社招", r"社招|社会招聘|experienced|professional|full time|full-time"),
    ("社招", r"\b(?:senior|staff|principal|lead|distinguished)\b"),
    ("全职", r"全职"),
]
RECRUIT_BUCKET_RULES = [
    ("intern", r"实习|intern"),
    ("campus", r"校招|校园招聘|应届|campus|graduate|new\s?grad"),
    ("social", r"社招|社会招聘|experienced|professional"),
]
COARSE_FUNCTION_RULES = [
    ("算法/AI", r"算法|machine\s?learning|\bml\b|\bai\b|nlp|\bcv\b|数据科学|data\s?scien"),
    ("研发", r"前端|后端|全栈|开发|工程师|研发|software|engineer|backend|frontend|测试|\bqa\b|运维|\bsre\b|devops"),
    ("产品", r"产品经理|产品|product\s?manager|\bpm\b"),
    ("设计", r"设计|design|\bux\b|\bui\b|交互"),
    ("运营", r"运营|operation"),
    ("市场", r"市场|marketing|品牌|公关|增长|growth"),
    ("销售", r"销售|sales|商务|\bbd\b"),
    ("职能", r"人力|\bhr\b|招聘|财务|法务|行政|finance|legal"),
]
JOB_FUNCTION_RULES = [
    ("产品", r"产品经理|产品运营|产品策划|产品负责人|产品总监|产品专家|product\s*manager|product\s*owner|technical\s*program\s*manager|\btpm\b|\bpm\b|\bpo\b"),
    ("设计", r"视觉设计|交互设计|ui\s*设计|ux|平面设计|设计师|designer"),
    ("数据", r"数据分析|数据科学|数据工程|大数据|数据挖掘|data\s*(?:analyst|scien|engineer)|\bbi\b|商业分析"),
    ("研发", r"工程师|研发|开发|算法|前端|后端|客户端|测试|运维|架构|嵌入式|硬件|engineer|developer|\bsde\b|\bsre\b|programmer|software|技术"),
    ("运营", r"用户运营|内容运营|运营|增长|operations|growth"),
    ("市场", r"市场|营销|品牌|公关|marketing|brand|\bpr\b"),
    ("销售", r"销售|商务拓展|\bbd\b|sales|客户经理|business\s*development"),
    ("供应链", r"供应链|采购|物流|仓储|supply\s*chain|procurement|logistics"),
    ("职能", r"人力资源|招聘|\bhr\b|财务|会计|审计|法务|法律|合规|行政|finance|legal|recruit|human\s*resources"),
]
NON_SOFTWARE_DOMAIN = (
    r"机械|机电|机加|钣金|工艺|化工|化学|材料|冶金|铸造|锻造|焊接|焊工|模具|注塑|液压|气动|数控|机床|刀具|工装|夹具|"
    r"热处理|土木|结构工程|岩土|暖通|给排水|管道|强电|工业工程|生产工艺|制造工艺|工艺技术|纺织|印染|涂装|总装|冲压|"
    r"车身|底盘|发动机|动力总成|整车|工业自动化|机械自动化"
)
SOFTWARE_SIGNAL = (
    r"软件|software|算法|algorithm|前端|frontend|front[\s-]?end|后端|backend|back[\s-]?end|全栈|full[\s-]?stack|客户端|"
    r"服务端|嵌入式|固件|firmware|测试开发|自动化测试|sdet|运维|sre|devops|架构师|代码|编程|程序员|programmer|\bjava\b|"
    r"python|golang|c\+\+|c#|\.net|javascript|typescript|\breact\b|\bvue\b|机器学习|machine\s*learning|深度学习|"
    r"deep\s*learning|\bml\b|\bnlp\b|大模型|\bllm\b|\bai\b|人工智能|计算机视觉|\bcv\b|系统开发|平台开发|web|\bapp\b|"
    r"小程序|数据库|database|\bsql\b|云计算|区块链"
)
DECLARED_INTERN = r"实习|\bintern"
DECLARED_SOCIAL = r"社招|社会招聘|全职|experienced|professional|full.?time"
DECLARED_CAMPUS = r"校招|校园招聘|应届|管培生|管理培训生|留学生专项|campus|new\s+grad|university\s+graduate|entry[-\s]?level"
CAMPUS_SIGNAL = (r"应届|[0-9]{2,4}届|校园招聘|校招|管培生|管理培训生|留学生专项|new\s?grads?\b|university\s+graduate|"
                 r"entry[-\s]?level|campus\s?(?:recruit|hiring)|graduate\s+program")
INTERN_SIGNAL = r"实习|shixi|\bintern(?:ship)?s?\b"
# superset used as a cheap first filter
CAMPUS_PREFILTER_TYPE = r"校招|校园招聘|应届|管培生|管理培训生|留学生专项|campus|new\s+grad|university\s+graduate|entry[-\s]?level"
CAMPUS_PREFILTER_TEXT = (r"应届|[0-9]{2,4}届|校园招聘|校招|管培生|管理培训生|留学生专项|new\s?grads?|university\s+graduate|"
                         r"entry[-\s]?level|campus\s?(?:recruit|hiring)|graduate\s+program")
STAGE_PATTERNS = {
    "实习": {"text": ["实习", "intern"], "url": ["shixi", "intern"]},
    "校招": {"text": ["校招", "校园", "应届", "campus", "graduate"], "url": ["campus"]},
}

# --- education ------------------------------------------------------------
EDUCATION_LEVELS = [
    ("博士", 6, r"博士|ph\.?d|doctorofphilosophy|doctora"),
    ("硕士", 5, r"硕士|研究生|master'?s?|m\.?s\.?|m\.?eng|m\.?sc"),
    ("本科", 4, r"本科|学士|bachelor'?s?|b\.?s\.?|b\.?a\.?|b\.?sc|undergrad"),
    ("大专", 3, r"大专|专科|associate('?s)?degree"),
]
EDUCATION_RANK_EXTRA = [
    (3, r"大专|专科|高职|associate('?s)?degree"),
    (2, r"高中|中专|中技|技校|职高"),
    (1, r"初中|小学"),
    (0, r"不限"),
]
EDUCATION_PREFERRED = (r"优先|加分|更佳|更优|为佳|亦可|也可|preferred|a\s+plus|is\s+a\s+plus|plus\b|nice\s+to\s+have|"
                       r"bonus|desirable|ideally")

# --- visa sponsorship -----------------------------------------------------
SPONSOR_NONE = [
    r"\bdo(?:es)? not sponsor\b", r"\bno (?:visa )?sponsorship\b",
    r"\bunable to (?:provide|offer) (?:visa )?sponsorship\b", r"without (?:visa )?sponsorship\b",
    r"must be authorized to work in the u\.?s", r"u\.?s\.? citizens? only",
    r"security clearance", r"not (?:able|eligible) to sponsor\b",
]
SPONSOR_AVAILABLE = [
    r"\b(?:visa )?sponsorship (?:is )?available\b", r"\bwill sponsor\b", r"\bwe sponsor\b",
    r"\bh-?1b sponsorship\b", r"sponsorship (?:is )?(?:provided|offered)\b",
    r"relocation and visa (?:support )?(?:provided|available)?\b",
]

# --- graduation class -----------------------------------------------------
GRAD_CLASS_PATTERNS = [
    r"(20\d{2})\s*届",
    r"(?:^|[^\d])(\d{2})\s*届",
    r"(20\d{2})\s*年?\s*(?:校招|秋招|春招|校园招聘|校园招募)",
    r"(20\d{2})\s*年?\s*应届",
    r"(20\d{2})\s*年?\s*实习生",
    r"(?i)class\s+of\s+(20\d{2})",
    r"(?i)(20\d{2})\s+(?:graduate|campus)",
]
GRAD_CLASS_RANGE = (2015, 2100)

# --- pay ------------------------------------------------------------------
PAY_CONTEXT = (r"(?:salary range|pay range|base pay range|compensation range|base salary range|salary of|base pay|"
               r"base salary|annual salary|expected salary|target salary|pay scale|compensation is|"
               r"total compensation|on-target earnings|\bOTE\b)")
PAY_RANGE = r"\$\s?([\d][\d,]{2,})\s?([kK])?\s?(?:-|–|—|to)\s?\$?\s?([\d][\d,]{2,})\s?([kK])?"

# --- dates ----------------------------------------------------------------
PUBLISH_TIME_FIELDS = [
    "publish_time", "publishTime", "first_publish_time", "online_time", "onlineTime",
    "create_time", "createTime", "update_time", "updateTime", "modify_time",
    "publish_date", "post_time", "posted_at", "pub_time",
]

# --- row quality gate -----------------------------------------------------
JOB_QUERY_KEYS = ["id", "code", "jobid", "jobcode", "positionid", "positioncode",
                  "postid", "reqid", "requestid", "requisitionid", "vacancyid"]
NAVIGATION_PATHS = [
    "/home", "/airecommendations", "/web/static/", "/static/index.html", "/recruithelp",
    "/client/home/", "/client/library/", "/client/techtalent/", "/externaljobs/login",
    "/externaljobs/redirect", "/siemens/position/index", "/siemens/user/", "/company/jobs/faq.html",
]

# --- companies ------------------------------------------------------------
# four separate normalisations: coverage, matching, target list, industry
COVER_SUFFIXES = ["股份有限公司", "有限公司", "集团", "控股", "中国", "china"]
TARGET_SUFFIXES = ["股份有限公司", "有限责任公司", "有限公司", "控股集团", "集团控股", "集团股份",
                   "控股", "集团", "科技", "公司", "中国"]
MATCH_STRIP = [
    r"(?i)（中国）|\(china\)|（大中华区）|中国区|大中华区",
    r"有限公司|股份有限公司|科技有限公司|集团|公司|股份|控股",
    r"(?i)(?<![a-z0-9_])(?:inc|ltd|llc|co|corp|corporation|company|technologies|technology|holdings|group)(?![a-z0-9_])",
    r"[\s.,，。、_\-—·&'\"’]",
]
SHARED_HOSTS = [
    "mokahr.com", "app.mokahr.com", "feishu.cn", "jobs.feishu.cn", "zhiye.com", "italent.cn",
    "hotjob.cn", "wecruit.hotjob.cn", "dayeetech.com", "eteams.cn",
    "yingjiesheng.com", "nowcoder.com", "maimai.cn", "zhihu.com", "weixin.qq.com", "mp.weixin.qq.com",
    "zhipin.com", "liepin.com", "lagou.com", "51job.com", "zhaopin.com",
]
JOB_IDENTITY_PATTERNS = [
    r"/position/(\d+)/detail", r"[?&]jobId=(\d+)", r"[?&]postId=([\w-]+)", r"/job-info/(\d+)",
    r"[?&]positionId=(\d+)", r"[?&]jobUnionId=(\d+)", r"/(\d{4,})(?:[/?#]|$)",
]
MIXED_BOARD_ADAPTERS = ["tencent", "baidu", "wt", "beisen"]

# --- freshness, in hours --------------------------------------------------
FRESHNESS_SLA = {"http": (18, 36), "playwright": (36, 72), "manual": (72, 144)}
VERIFY_HOURS = {"today": 24, "search": 72, "admin": None}

# --- keyword groups: (function, terms); the default set is small, larger sets come from JSON
KEYWORD_GROUPS = [
    ("研发", ["算法", "机器学习", "深度学习", "大模型", "人工智能", "algorithm", "machine learning", "llm", "nlp", "ai"]),
    ("数据", ["数据分析", "数据分析师", "商业分析", "bi", "data analyst", "sql"]),
    ("数据", ["数据工程", "数据开发", "数据仓库", "大数据", "data engineer", "etl"]),
    ("产品", ["产品经理", "产品", "product manager", "pm", "产品运营"]),
    ("研发", ["前端", "前端开发", "frontend", "front-end", "react", "vue", "javascript"]),
    ("研发", ["后端", "后端开发", "服务端", "backend", "back-end", "java", "golang"]),
    ("研发", ["测试", "测试开发", "qa", "sdet", "test engineer"]),
    ("研发", ["运维", "devops", "sre", "云原生"]),
    ("研发", ["安全", "网络安全", "信息安全", "security engineer"]),
    ("设计", ["设计", "视觉设计", "交互设计", "ui", "ux", "designer"]),
    ("运营", ["运营", "用户运营", "内容运营", "operations"]),
    ("市场", ["市场", "市场营销", "品牌", "公关", "marketing"]),
    ("销售", ["销售", "商务拓展", "客户经理", "sales", "bd"]),
    ("职能", ["财务", "会计", "审计", "finance", "accounting"]),
    ("职能", ["人力资源", "人力", "招聘", "hr", "recruiter"]),
    ("职能", ["法务", "法律", "合规", "legal", "compliance"]),
    ("供应链", ["供应链", "采购", "物流", "supply chain", "procurement"]),
    ("研发", ["硬件", "嵌入式", "芯片", "hardware", "firmware"]),
    (None, ["投研", "行业研究", "投资研究", "equity research"]),
    (None, ["管培生", "校招", "校园招聘", "应届", "graduate", "campus"]),
    (None, ["实习", "实习生", "intern", "internship"]),
    (None, ["工程师", "engineer", "研发", "developer"]),
    (None, ["软件", "software"]),
]
TITLE_ONLY_ANCHORS = ["工程师", "engineer", "研发", "developer", "软件", "software"]

# --- hiring insight -------------------------------------------------------
HEADCOUNT_APPROX = {"1-100": 50, "100-500": 300, "500-1000": 750, "1000-5000": 3000,
                    "5000-1万": 7500, "1万-5万": 30000, "5万-10万": 75000, "10万+": 150000}

# English wording of role groups for overseas searches
OVERSEAS_LEXICON = [
    ["产品经理", "product manager", "pm", "product owner", "program manager"],
    ["项目经理", "project manager", "program manager"],
    ["算法", "algorithm", "machine learning", "ml engineer", "ai engineer"],
    ["后端", "backend", "back-end", "server-side", "server side"],
    ["前端", "frontend", "front-end", "web developer", "web engineer"],
    ["数据分析", "data analyst", "analytics", "business analyst"],
    ["运营", "operations", "ops", "business operations"],
    ["设计", "designer", "ux", "ui", "product designer"],
    ["市场", "marketing", "growth marketing", "brand marketing"],
    ["销售", "sales", "business development", "account executive"],
]

# company to industry by name, first match wins
INDUSTRY_RULES = [
    ("金融", r"银行|证券|保险|基金|信托|期货|资管|财险|寿险|金融|支付|消费金融|小额贷|bank|securities|insurance|capital"),
    ("医疗/医药", r"医药|制药|药业|药品|生物医药|生物科技|医疗|医院|健康|基因|诊断|器械|pharma|biotech|medical|health"),
    ("汽车/出行", r"汽车|整车|车业|新能源车|乘用车|商用车|车联网|出行|motors|automotive"),
    ("能源/化工", r"能源|电力|电网|石油|石化|化工|化学|新能源|光伏|风电|储能|电池|燃气|煤业|核电|energy|power|chemical|petro"),
    ("物流/供应链", r"物流|快递|供应链|仓储|货运|运输|冷链|logistics|express|supply\s*chain"),
    ("地产/建筑", r"地产|置业|房产|建筑|建设|建工|工程局|装饰|幕墙|real\s*estate|construction|properties"),
    ("教育", r"教育|学校|培训|学院|课程|留学|education|academy"),
    ("传媒/文娱", r"传媒|影视|文化|娱乐|院线|音乐|动漫|文娱|出版|media|entertainment"),
    ("消费/零售", r"食品|饮料|乳业|乳品|零售|商超|百货|便利店|美妆|化妆品|日化|服饰|服装|鞋业|家居|家电|餐饮|连锁|消费|快消|retail|consumer|foods?|beverage"),
    ("制造/工业", r"制造|机械|重工|工业|装备|设备|电子|半导体|芯片|集成电路|材料|钢铁|有色|精密|模具|纺织|轻工|manufactur|industrial|electronics|semiconductor"),
    ("互联网/科技", r"互联网|科技|网络|信息技术|软件|数码|智能|大数据|云计算|游戏|网游|人工智能|物联网|tech|software|digital|internet|\bai\b|cloud"),
]
# a user's own wording of an industry
USER_INDUSTRY_RULES = [
    ("互联网/科技", r"互联网|科技|信息技术|软件|计算机|it|tech|游戏|人工智能|\bai\b|大数据|云"),
    ("金融", r"金融|银行|证券|保险|基金|投资|fintech|finance"),
    ("消费/零售", r"消费|零售|快消|fmcg|电商|食品|饮料|美妆|服装|retail|consumer"),
    ("制造/工业", r"制造|工业|机械|电子|半导体|芯片|材料|硬件|manufactur|industrial"),
    ("汽车/出行", r"汽车|车|出行|新能源车|automotive"),
    ("医疗/医药", r"医疗|医药|生物|制药|健康|器械|pharma|bio|medical|health"),
    ("能源/化工", r"能源|电力|化工|化学|新能源|光伏|电池|energy|chemical"),
    ("地产/建筑", r"地产|房地产|建筑|建设|工程|real\s*estate|construction"),
    ("物流/供应链", r"物流|供应链|快递|运输|logistics|supply"),
    ("传媒/文娱", r"传媒|文娱|影视|文化|娱乐|内容|media|entertainment"),
    ("教育", r"教育|培训|edu"),
]
COMPANY_ORIGINS = {
    "中国": ["字节跳动", "腾讯", "阿里巴巴", "百度", "京东", "美团", "华为", "小米", "蔚来", "小鹏汽车", "地平线", "比亚迪", "宁德时代",
            "快手", "小红书", "网易", "海尔", "shlab", "招商银行", "中国移动", "理想汽车", "商汤", "寒武纪"],
    "美企": ["Apple", "Microsoft", "Amazon", "Tesla", "Google", "Meta", "J&J", "AbbVie", "Merck", "Anthropic", "Reddit", "Discord",
            "Cloudflare", "Figma", "Twilio", "Airtable", "Nvidia", "Intel"],
    "德企": ["Siemens", "Bosch", "SAP", "BMW", "Mercedes"],
    "欧企": ["Roche", "Novartis", "Nestle", "L'Oreal"],
    "日企": ["Sony", "Toyota", "Honda", "Panasonic", "Nintendo"],
}
FOREIGN_ADAPTERS = [
    "apple", "apple_cn", "siemens", "greenhouse", "lever", "ashby", "smartrecruiters", "successfactors",
    "workday", "eightfold", "oracle", "amazon", "phenom", "microsoft", "google",
]

# --- daily feed -----------------------------------------------------------
RECALL_TIERS = [("role", 0, 5), ("company", 1, 2), ("cityNew", 2, 3)]
RECALL_BUDGET = 900
SCORE_TIERS = [(70, "high"), (45, "related"), (30, "explore")]
SIGNAL_PRIORITY = {"CLOSED_OR_STALE": 1, "DEADLINE_SOON": 2, "STILL_OPEN": 3, "OPEN_UNVERIFIED": 4}
EXPLORE_CAP = 5
WAITING_CAP = 8

# fixed values: detail pages of known platforms as (host pattern, path pattern, query pattern, fragment pattern); None is no test
DETAIL_PAGES = {
    "apple": (r"^jobs\.apple\.com$", r"^/en-us/details/[^/]+/[^/]+", None, None),
    "baidu": (r"^talent\.baidu\.com$", r"^/jobs/detail/(SOCIAL|GRADUATE|INTERN)/[^/]+", None, None),
    "jd": (r"^zhaopin\.jd\.com$", r"^/web/job-info-detail$", r"(?:^|&)requementId=\d+(?:&|$)", None),
    "greenhouse": (r"greenhouse\.io$", r"/jobs/[^/]+", None, None),
    "lever": (r"^jobs\.lever\.co$", r"^/[^/]+/[^/]+", None, None),
    "moka": (r"^app\.mokahr\.com$", r"^/(apply|campus_apply|social-recruitment)/[^/]+", None, r"^/job/[^/]+"),
}
# fixed values: paths, queries and words that tell a list page from a detail page of other sites
LIST_PATH = r"/(search|list|jobs?|careers?|career|campus|social|position|positions|recruit|recruitment|joinus|join-us|index)/?$"
LIST_QUERY = r"(search|keyword|query|page)="
ID_QUERY = r"(id|jobid|job_id|postid|positionid|position_id|requementid|requirementid)="
DETAIL_WORDS = ["detail", "job", "jobs", "position", "positions", "opening", "openings", "recruit", "joinus", "career", "careers"]
DETAIL_WORDS_CJK = ["招聘", "职位", "岗位"]
