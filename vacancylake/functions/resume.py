"""Resume texts: headline, target roles, cities, skills, stage, education and experience lines."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import any_contains, col, let, text

# fixed values: vocabularies of resumes, in order of rank
ROLES = [
    ("数据分析", ["数据分析", "data analyst", "数据运营", "BI", "商业分析"]), ("商业分析", ["商业分析", "business analyst"]),
    ("产品经理", ["产品经理", "产品实习", "product manager", "PM", "AI 产品"]), ("算法", ["算法", "机器学习", "深度学习", "大模型", "推荐系统", "NLP", "CV"]),
    ("投研", ["投研", "行业研究", "股票研究", "固收", "量化", "equity research"]), ("管培生", ["管培生", "管理培训生", "management trainee", "graduate program"]),
    ("运营", ["运营", "用户增长", "增长运营", "内容运营"]),
]
SKILLS = ["Python", "SQL", "R", "Excel", "Tableau", "Power BI", "Figma", "Axure", "AI 产品", "机器学习", "深度学习", "大模型", "RAG", "Prompt", "A/B 实验", "用户研究", "数据分析", "数据可视化", "Pandas", "Spark"]
CITIES = ["北京", "上海", "深圳", "广州", "杭州", "南京", "苏州", "成都", "武汉", "西安", "香港", "新加坡", "远程"]
INDUSTRIES = [("互联网", "互联网|电商|平台|用户增长"), ("金融", "金融|投研|证券|基金|银行|量化"), ("AI", "(?i)AI|人工智能|大模型|机器学习|深度学习|RAG|Prompt"), ("咨询", "咨询|战略|商业分析")]
STAGES = [("实习", "(?i)暑期实习|日常实习|实习|intern"), ("校招", "(?i)校招|应届|毕业生|new grad|campus"), ("社招", "(?i)社招|工作经验|全职|experienced")]
NO_STAGE, NO_HEADLINE = "未判断", "未命名用户画像"
INTENT, INTENT_LABEL = "求职意向|目标岗位|应聘岗位|期望岗位", r"(?i)^(求职意向|目标岗位|应聘岗位|期望岗位)\s*[:：]\s*"
MEANINGFUL, SKILL_LINE = "岗位|分析|产品|算法|投研|运营|实习|校招", "技能|技术栈|工具|熟练|掌握"
EDUCATION_LINE, EXPERIENCE_LINE = "教育|学历|学校|大学|学院|本科|硕士|博士", "实习|经历|工作|项目|负责|公司|研究"
HEADLINE_CHARS, LINE_CHARS, LINES, SUMMARY_CHARS, SUMMARY_SKILLS = 80, 160, 8, 320, 8
PREFERRED = {"target_locations": 6, "target_roles": 6, "skills": 16, "industries": 6}
ENGLISH_ITEMS, ENGLISH_CHARS = 30, 80

EDGE = r"^[\s 　﻿]+|[\s 　﻿]+$"


def _strip(c) -> Column:
    return F.regexp_replace(c, EDGE, "")


def in_order(low: Column, terms) -> Column:
    """Terms found in a lower-case text, by first place, shorter ones first at one place."""
    # places are sought only for terms that a byte search finds
    found = F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.struct(F.instr(low, t.lower()).alias("at"), F.lit(len(t)).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")))
                                      for i, t in enumerate(terms)]))
    return F.transform(F.sort_array(found), lambda x: x["t"])


def _listed(rules) -> Column:
    """Labels of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in rules]), lambda x: x.isNotNull())


def _roles(low: Column) -> Column:
    return _listed([(role, any_contains(low, [a.lower() for a in aliases])) for role, aliases in ROLES])


def _words(pattern: str) -> list[str]:
    """Words of a pattern that is nothing but alternatives."""
    return pattern.removeprefix("(?i)").split("|")


def _names(c: Column, pattern: str) -> Column:
    """Whether a text holds a word of the pattern, by byte search."""
    return any_contains(c, _words(pattern))


def _told(plain: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern occurs; without regard to case it is matched only where the lower-case text holds a word of it."""
    if not pattern.startswith("(?i)"):
        return _names(plain, pattern)
    return any_contains(low, [w.lower() for w in _words(pattern)]) & plain.rlike(pattern)


def resume_lines(c) -> Column:
    """Trimmed lines with something in them."""
    one = F.replace(F.replace(text(c), F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    plain = let(one, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    return F.filter(F.transform(F.split(plain, r"\n+"), _strip), lambda x: x != "")


def _section(lines: Column, pattern: str) -> Column:
    return F.slice(F.transform(F.filter(lines, lambda x: _names(x, pattern)), lambda x: F.substring(x, 1, LINE_CHARS)), 1, LINES)


def _summary(lines: Column) -> Column:
    return F.substring(F.array_join(F.filter(F.transform(lines, _strip), lambda x: x != ""), "；"), 1, SUMMARY_CHARS)


def parse_resume(c) -> Column:
    """Profile of a whole resume text: struct(headline, target_roles, target_locations, skills, industries, stage, education,
    experience, education_summary, experience_summary, summary). A missing or blank text has the general headline and no entries."""
    def read(x):
        lines, plain = x["lines"], x["plain"]
        first = lambda pattern: F.get(F.filter(lines, lambda l: _names(l, pattern)), F.lit(0))
        head = let(first(INTENT), lambda intent: F.when(intent.isNotNull(), _strip(F.regexp_replace(intent, INTENT_LABEL, "")))
                   .otherwise(F.coalesce(first(MEANINGFUL), F.get(lines, F.lit(0)), F.lit(NO_HEADLINE))))
        return F.struct(F.substring(head, 1, HEADLINE_CHARS).alias("headline"), plain.alias("plain"), F.lower(plain).alias("low"), lines.alias("lines"))

    def profile(x):
        head, low, lines = x["headline"], x["low"], x["lines"]
        roles = let(let(F.lower(head), _roles), lambda r: F.when(F.size(r) > 0, r).otherwise(_roles(low)))
        named = let(F.lower(F.array_join(F.filter(lines, lambda l: _names(l, SKILL_LINE)), "\n")), lambda t: in_order(t, SKILLS))
        return F.struct(head.alias("headline"), x["plain"].alias("plain"), low.alias("low"), roles.alias("roles"), in_order(low, CITIES).alias("cities"), named.alias("named"), in_order(low, SKILLS).alias("all"),
                        _section(lines, EDUCATION_LINE).alias("education"), _section(lines, EXPERIENCE_LINE).alias("experience"))

    def finish(x):
        plain, low = x["plain"], x["low"]
        extra = F.filter(x["all"], lambda s: ~(F.array_contains(x["roles"], "数据分析") & (s == "数据分析")) & ~F.array_contains(x["named"], s))
        stage = F.coalesce(*[F.when(_told(plain, low, p), F.lit(s)) for s, p in STAGES], F.lit(NO_STAGE))

        def whole(skills):
            part = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, "、")))
            told = F.concat_ws("；", F.nullif(x["headline"], F.lit("")), part("方向：", x["roles"]), part("城市：", x["cities"]), part("技能：", F.slice(skills, 1, SUMMARY_SKILLS)))
            return F.struct(x["headline"].alias("headline"), x["roles"].alias("target_roles"), x["cities"].alias("target_locations"), skills.alias("skills"),
                            _listed([(label, _told(plain, low, p)) for label, p in INDUSTRIES]).alias("industries"), stage.alias("stage"), x["education"].alias("education"), x["experience"].alias("experience"),
                            _summary(x["education"]).alias("education_summary"), _summary(x["experience"]).alias("experience_summary"), told.alias("summary"))
        return let(F.concat(x["named"], extra), whole)

    whole_text = let(resume_lines(c), lambda ls: F.struct(ls.alias("lines"), F.array_join(ls, "\n").alias("plain")))
    return let(let(let(whole_text, read), profile), finish)


def preferences(profile) -> Column:
    """Preferences a profile stands for: struct(target_locations, target_roles, target_keywords, industries), each cut to its limit."""
    p = col(profile)
    cut = lambda name: F.slice(F.array_distinct(p[name]), 1, PREFERRED[name])
    return F.struct(cut("target_locations").alias("target_locations"), cut("target_roles").alias("target_roles"), cut("skills").alias("target_keywords"), cut("industries").alias("industries"))


def clean_strings(c) -> Column:
    """Entries with blanks collapsed and cut, without empty ones and repeats in another case, at most ENGLISH_ITEMS."""
    plain = F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), lambda s: F.substring(_strip(F.regexp_replace(text(s), r"\s+", " ")), 1, ENGLISH_CHARS)), lambda s: s != "")
    return F.slice(F.aggregate(plain, F.array().cast("array<string>"), lambda out, s: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(s)), out).otherwise(F.array_append(out, s))), 1, ENGLISH_ITEMS)


def english_profile(profile) -> Column:
    """Columns of the English profile that a parsed resume fills."""
    p = col(profile)
    return let(clean_strings(p["skills"]), lambda s: F.struct(clean_strings(p["target_roles"]).alias("en_target_roles"), s.alias("en_skills"), s.alias("en_target_keywords"), F.lit(True).alias("has_en_resume")))
