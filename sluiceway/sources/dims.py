"""Dimension tables. Fixed values, each in its own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: code, name, site domain, publisher keys, library type, listing url, listing pattern
DEPARTMENTS = [
    ("ndrc", "国家发展和改革委员会", "ndrc.gov.cn", ["发展改革委"], None, "https://www.ndrc.gov.cn/xxgk/zcfb/fzggwl/", r'href="([^"]*t(\d{8})_\d+\.html)"[^>]*>\s*([^<]{6,120})<'),
    ("miit", "工业和信息化部", "miit.gov.cn", ["工业和信息化部"], None, "https://www.miit.gov.cn/", r'href="(https?://www\.miit\.gov\.cn/zwgk/zcwj/wjfb/\w+/art/(\d{4})/art_[0-9a-f]+\.html)"[^>]*>\s*([^<]{6,120})<'),
    ("mem", "应急管理部", "mem.gov.cn", ["应急管理部"], None, "https://www.mem.gov.cn/gk/tzgg/", r'href="([^"]*t(\d{8})_\d+\.shtml)"[^>]*>\s*([^<]{6,120})<'),
    ("gov", "国务院", "gov.cn", [], "state_council", None, None),
    ("mee", "生态环境部", "mee.gov.cn", ["生态环境部"], None, None, None),
    ("samr", "市场监管总局", "samr.gov.cn", ["市场监管总局"], None, None, None),
    ("nea", "国家能源局", "nea.gov.cn", ["能源局"], None, None, None),
    ("mof", "财政部", "mof.gov.cn", ["财政部"], None, None, None),
]
#: code, Chinese name, English name, site domain, type, language, report types
INSTITUTIONS = [
    ("sinopec", "中国石化", "Sinopec", "sinopec.com", "soe_domestic", "zh", ["年度报告", "可持续发展报告", "新闻稿"]),
    ("petrochina", "中国石油", "PetroChina / CNPC", "cnpc.com.cn", "soe_domestic", "zh", ["年度报告", "可持续发展报告", "新闻稿"]),
    ("cnooc", "中国海油", "CNOOC", "cnooc.com.cn", "soe_domestic", "zh", ["年度报告", "可持续发展报告", "新闻稿"]),
    ("sinochem", "中化集团", "Sinochem", "sinochem.com", "soe_domestic", "zh", ["年度报告", "新闻稿"]),
    ("yanchang", "延长石油", "Yanchang Petroleum", "ycpg.cn", "soe_domestic", "zh", ["年度报告", "新闻稿"]),
    ("exxonmobil", "埃克森美孚", "ExxonMobil", "exxonmobil.com", "intl_major", "en", ["年度报告", "可持续发展报告", "新闻稿", "能源展望"]),
    ("shell", "壳牌", "Shell", "shell.com", "intl_major", "en", ["年度报告", "可持续发展报告", "新闻稿", "能源展望"]),
    ("bp", "英国石油", "BP", "bp.com", "intl_major", "en", ["年度报告", "可持续发展报告", "新闻稿", "能源展望"]),
    ("totalenergies", "道达尔能源", "TotalEnergies", "totalenergies.com", "intl_major", "en", ["年度报告", "可持续发展报告", "新闻稿"]),
    ("chevron", "雪佛龙", "Chevron", "chevron.com", "intl_major", "en", ["年度报告", "可持续发展报告", "新闻稿"]),
    ("cpcif", "中国石油和化学工业联合会", "CPCIF", "cpcif.org.cn", "research_institute", "zh", ["行业运行报告", "统计数据", "新闻稿"]),
    ("iea", "国际能源署", "IEA", "iea.org", "research_institute", "en", ["世界能源展望", "研究报告", "月度报告"]),
    ("opec", "石油输出国组织", "OPEC", "opec.org", "research_institute", "en", ["月度石油市场报告", "年度统计公报"]),
    ("woodmac", "伍德麦肯兹", "Wood Mackenzie", "woodmac.com", "research_institute", "en", ["行业研究报告", "市场洞察"]),
]
#: key, label, aliases, sections
TEMPLATES = [
    ("员工安全知识培训", "安全生产培训 / 危化品管理", ["安全生产培训", "安全培训", "危化品管理", "危化品", "HSE 培训", "员工培训", "政策宣贯"], ["安全方针与责任", "风险辨识与管控", "操作规程要点", "应急处置与案例"]),
    ("项目立项汇报模版", "项目立项 / 申报评审", ["项目立项汇报", "项目申报", "项目立项", "立项", "课题答辩", "项目汇报", "申报评审"], ["项目背景与立项依据", "现状分析与问题诊断", "建设目标与总体思路", "建设内容与总体方案", "实施计划与人员安排", "项目经费与效益"]),
    ("年终安全工作汇报模版", "年终总结 / 工作汇报", ["年终安全工作汇报", "年终总结", "年度总结", "工作汇报", "安全汇报", "工作总结", "年终汇报"], ["年度工作总览", "安全制度建设", "典型问题分析", "不足与风险", "下年度计划"]),
    ("重大事件专项汇报", "专项汇报 / 应急事件", ["专项汇报", "事故汇报", "应急事件", "重大事件", "事件汇报", "事故调查"], ["事件概述", "应急响应情况", "影响范围与风险评估", "事件原因及性质", "责任分析与处理结果", "防范与整改措施"]),
    ("通用模板", "通用 / 任意主题", ["通用", "自定义", "其他", "不限", "任意主题", "自由主题"], ["背景与目标", "现状分析", "实施方案", "计划安排", "总结展望"]),
]


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEPARTMENTS, "code string, name string, site_domain string, puborg_keys array<string>, library_type string, list_url string, link_pattern string")


def institutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTITUTIONS, "code string, name_zh string, name_en string, site_domain string, org_type string, language string, report_types array<string>")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "ord int, key string, label string, aliases array<string>, sections array<string>")


def resolve_template(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, key, label): the template of that key, else the first that has the name among its aliases; null key if none."""
    own = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("key").alias("name"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("rank"), a.alias("name"))))
    known = registry.select("ord", "key", "label", F.explode(own).alias("x")).groupBy(F.col("x.name").alias("name")).agg(F.min_by(F.struct("key", "label"), F.struct("x.rank", "ord")).alias("x"))
    return names.select("name").distinct().join(known, "name", "left").select("name", "x.*")


def resolve_department(codes: DataFrame, dims: DataFrame) -> DataFrame:
    """(code, name, site_domain) with the code itself and '' for unknown ones."""
    return codes.join(dims, "code", "left").select("code", F.coalesce("name", "code").alias("name"), F.coalesce("site_domain", F.lit("")).alias("site_domain"))


def unknown_departments(codes: DataFrame, dim: DataFrame) -> DataFrame:
    """The rows of codes (code) that name no department."""
    return codes.join(dim.select("code"), "code", "left_anti")


def default_sections(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, sections): those given with a name (array sections), else its template's."""
    own = resolve_template(names.select("name").distinct(), registry).join(registry.select("key", F.col("sections").alias("usual")), "key", "left")
    given = F.when(F.size(F.coalesce("sections", F.array().cast("array<string>"))) > 0, F.col("sections"))
    return names.join(own.select("name", "usual"), "name", "left").select("name", F.coalesce(given, "usual").alias("sections"))
