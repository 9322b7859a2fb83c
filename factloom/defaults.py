"""Default vocabulary. Every operator takes these as parameters.

All lists in this module are fixed values: they must equal the names used in
the reports and in the requests, or lookups would not meet their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BALANCE_SHEET = "BẢNG CÂN ĐỐI KẾ TOÁN"
INCOME_STATEMENT = "BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH"
CASH_FLOW = "BÁO CÁO LƯU CHUYỂN TIỀN TỆ"
STATEMENTS = (BALANCE_SHEET, INCOME_STATEMENT, CASH_FLOW)

# Words that make a line a heading; columns that hold neither
# labels nor amounts; the column with the item code.
HEADING_MARKERS = ("BẢNG", "BÁO CÁO")
IGNORED_COLUMNS = ("mã số", "thuyết minh")
CODE_COLUMN = "Mã số"

# Sentences of the retrieval text.
COMPANY_WORD = "Công ty"
TABLE_WORD = "Bảng"
VALUE_WORD = "Giá trị"

# Retrieval and presentation constants.
TOP_K = 5
FUZZY_CUTOFF = 0.88
LOOKUPS_PER_TABLE = 2
OBSERVATION_CHARS = 1200
RAW_PREVIEW_CHARS = 300
EMPTY_CONTEXT = "<EMPTY_CONTEXT>"
RETRIEVAL_SOURCE = "document.md"
LOOKUP_TOOL = "get_related_info"
NO_ANSWER = "Chưa đủ dữ liệu để trả lời."
MISSING_TITLE = "Thiếu:"
ANSWER_TAG = "ANSWER: "

# Table abbreviations and spellings -> canonical table name.
TABLE_CANON = {
    "bảng cân đối kế toán": BALANCE_SHEET,
    "báo cáo kết quả hoạt động kinh doanh": INCOME_STATEMENT,
    "báo cáo lưu chuyển tiền tệ": CASH_FLOW,
    "bcdkt": BALANCE_SHEET,
    "bcđkt": BALANCE_SHEET,
    "kqhđkd": INCOME_STATEMENT,
    "kqhdkd": INCOME_STATEMENT,
    "lctt": CASH_FLOW,
}

# Which worker reads which statement, and its tools.
TABLE_WORKERS = {
    BALANCE_SHEET: "agent_bs",
    INCOME_STATEMENT: "agent_is",
    CASH_FLOW: "agent_cf",
}
WEB_WORKER = "agent_web"
WORKERS = ("agent_bs", "agent_is", "agent_cf", "agent_web")
ALLOWED_TOOLS = {
    "agent_bs": ("get_related_info",),
    "agent_is": ("get_related_info",),
    "agent_cf": ("get_related_info",),
    "agent_web": ("web_search",),
}
KNOWN_TOOLS = ("get_related_info", "web_search", "calculate_dti")
# The arguments that a tool takes, all of them needed.
TOOL_ARGUMENTS = {"get_related_info": ("query", "table"), "web_search": ("query",), "calculate_dti": ()}

# The line items that may be asked for, per statement.
KEYWORDS = {
    BALANCE_SHEET: (
        "tài sản ngắn hạn",
        "tài sản dài hạn",
        "tổng cộng tài sản",
        "tiền và các khoản tương đương tiền",
        "tiền",
        "các khoản tương đương tiền",
        "các khoản phải thu ngắn hạn",
        "phải thu ngắn hạn của khách hàng",
        "phải thu ngắn hạn khác",
        "hàng tồn kho",
        "đầu tư tài chính ngắn hạn",
        "đầu tư tài chính dài hạn",
        "tài sản cố định",
        "tài sản cố định hữu hình",
        "tài sản cố định vô hình",
        "bất động sản đầu tư",
        "chi phí trả trước ngắn hạn",
        "chi phí trả trước dài hạn",
        "nợ phải trả",
        "nợ ngắn hạn",
        "nợ dài hạn",
        "vay và nợ thuê tài chính ngắn hạn",
        "vay và nợ thuê tài chính dài hạn",
        "phải trả người bán ngắn hạn",
        "phải trả ngắn hạn khác",
        "thuế và các khoản phải nộp nhà nước",
        "chi phí phải trả ngắn hạn",
        "chi phí phải trả dài hạn",
        "người mua trả tiền trước ngắn hạn",
        "người mua trả tiền trước dài hạn",
        "vốn chủ sở hữu",
        "vốn góp của chủ sở hữu",
        "lợi nhuận sau thuế chưa phân phối",
        "tổng cộng nguồn vốn",
    ),
    INCOME_STATEMENT: (
        "doanh thu bán hàng và cung cấp dịch vụ",
        "các khoản giảm trừ doanh thu",
        "doanh thu thuần về bán hàng và cung cấp dịch vụ",
        "giá vốn hàng bán",
        "lợi nhuận gộp về bán hàng và cung cấp dịch vụ",
        "doanh thu hoạt động tài chính",
        "chi phí tài chính",
        "chi phí lãi vay",
        "chi phí bán hàng",
        "chi phí quản lý doanh nghiệp",
        "lợi nhuận thuần từ hoạt động kinh doanh",
        "thu nhập khác",
        "chi phí khác",
        "lợi nhuận khác",
        "tổng lợi nhuận kế toán trước thuế",
        "chi phí thuế tndn hiện hành",
        "chi phí thuế tndn hoãn lại",
        "lợi nhuận sau thuế thu nhập doanh nghiệp",
        "lãi cơ bản trên cổ phiếu",
        "lãi suy giảm trên cổ phiếu",
    ),
    CASH_FLOW: (
        "tiền thu từ bán hàng, cung cấp dịch vụ và doanh thu khác",
        "tiền chi trả cho người cung cấp hàng hóa và dịch vụ",
        "tiền chi trả cho người lao động",
        "tiền lãi vay đã trả",
        "thuế thu nhập doanh nghiệp đã nộp",
        "tiền thu khác từ hoạt động kinh doanh",
        "tiền chi khác cho hoạt động kinh doanh",
        "lưu chuyển tiền thuần từ hoạt động kinh doanh",
        "tiền chi để mua sắm, xây dựng tscđ và các tài sản dài hạn khác",
        "tiền thu từ thanh lý, nhượng bán tscđ và các tài sản dài hạn khác",
        "tiền chi cho vay, mua các công cụ nợ của đơn vị khác",
        "tiền thu hồi cho vay, bán lại các công cụ nợ của đơn vị khác",
        "tiền chi đầu tư góp vốn vào đơn vị khác",
        "tiền thu hồi đầu tư góp vốn vào đơn vị khác",
        "tiền thu lãi cho vay, cổ tức và lợi nhuận được chia",
        "lưu chuyển tiền thuần từ hoạt động đầu tư",
        "tiền thu từ phát hành cổ phiếu, nhận vốn góp của chủ sở hữu",
        "tiền thu từ đi vay",
        "tiền trả nợ gốc vay",
        "cổ tức, lợi nhuận đã trả cho chủ sở hữu",
        "lưu chuyển tiền thuần từ hoạt động tài chính",
        "lưu chuyển tiền thuần trong kỳ",
        "tiền và tương đương tiền đầu kỳ",
        "tiền và tương đương tiền cuối kỳ",
        "ảnh hưởng của thay đổi tỷ giá hối đoái quy đổi ngoại tệ",
    ),
}

# Common variants -> canonical keyword.
ALIASES = {
    "tiền và tương đương tiền": "tiền và các khoản tương đương tiền",
    "phải thu khách hàng ngắn hạn": "phải thu ngắn hạn của khách hàng",
    "chi phí qldn": "chi phí quản lý doanh nghiệp",
    "lnst": "lợi nhuận sau thuế thu nhập doanh nghiệp",
    "doanh thu thuần": "doanh thu thuần về bán hàng và cung cấp dịch vụ",
    "lợi nhuận sau thuế": "lợi nhuận sau thuế thu nhập doanh nghiệp",
    "tiền cuối kỳ": "tiền và tương đương tiền cuối kỳ",
    "tiền đầu kỳ": "tiền và tương đương tiền đầu kỳ",
    "lctt hđkd": "lưu chuyển tiền thuần từ hoạt động kinh doanh",
}

# Ratio -> (role, statement, line item).
CONCEPTS = (
    ("hệ số thanh toán", "numerator", BALANCE_SHEET, "tài sản ngắn hạn"),
    ("hệ số thanh toán", "denominator", BALANCE_SHEET, "nợ ngắn hạn"),
    ("ROE", "numerator", INCOME_STATEMENT, "lợi nhuận sau thuế thu nhập doanh nghiệp"),
    ("ROE", "denominator", BALANCE_SHEET, "vốn chủ sở hữu"),
)


def literal_table(spark: SparkSession, names: str, rows) -> DataFrame:
    """A short list as a table whose size Spark knows, so that it can decide
    to broadcast it before anything is shuffled."""

    def value(v):
        return F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v)

    columns = names.split()
    structs = [F.struct(*[value(v).alias(n) for n, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def keyword_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(t, k) for t, ks in KEYWORDS.items() for k in ks]
    return literal_table(spark, "tbl keyword", rows)


def keyword_aliases(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "variant canonical", ALIASES.items())


def table_canon(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "key canonical", TABLE_CANON.items())


def allowed_tools(spark: SparkSession) -> DataFrame:
    rows = [(a, t) for a, ts in ALLOWED_TOOLS.items() for t in ts]
    return literal_table(spark, "agent tool", rows)


def concept_items(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "concept role tbl keyword", CONCEPTS)
