"""Default rule sets for Vietnamese legal text.

All constants in this file are FIXED VALUES: word lists, labels and thresholds that
results must agree with. Every operator takes its rule set as an argument; these are
the defaults. ``rule_table`` turns a rule set into a DataFrame when it is needed as a
join side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: confirmed wrong phrases and their corrections ---------------------
PHRASE_ERRORS = {
    "viện kiểm xát": "viện kiểm sát",
    "kiểm xát viên": "kiểm sát viên",
    "thực hành quyển công tố": "thực hành quyền công tố",
    "quyết định khỏi tố": "quyết định khởi tố",
    "quyêt định": "quyết định",
    "khởi tộ": "khởi tố",
    "truy té": "truy tố",
    "bị cao": "bị cáo",
    "cáo chạng": "cáo trạng",
    "tạm dữ": "tạm giữ",
    "tạm giử": "tạm giữ",
    "tạm ghim": "tạm giam",
    "thẩm quyển": "thẩm quyền",
    "điểu tra": "điều tra",
    "kiễm sát": "kiểm sát",
    "kiểm xát": "kiểm sát",
    "trách nhiêm": "trách nhiệm",
    "pháp luât": "pháp luật",
    "bổ xung": "bổ sung",
    "xát nhập": "sáp nhập",
    "sát nhập": "sáp nhập",
    "chuẩn đoán": "chẩn đoán",
    "tham ô tài sãn": "tham ô tài sản",
    "xâm phạm sở hửu": "xâm phạm sở hữu",
    "vật chứn": "vật chứng",
    "bút lụt": "bút lục",
    "biên bãn": "biên bản",
    "đương sư": "đương sự",
    "thi hành áng": "thi hành án",
}

# --- fixed values: words of the legal domain added to the dictionary -----------------
DOMAIN_WORDS = """
án phí bút lục bị can bị cáo bị hại đương sự nguyên đơn bị đơn công tố kiểm sát
kiểm sát viên kiểm sát việc khởi tố truy tố điều tra xét xử thi hành án tạm giữ
tạm giam cáo trạng luận tội kháng nghị kháng cáo kiến nghị đình chỉ giám định
định giá vật chứng chứng cứ tố giác tin báo phạm tội thi hành quyền công tố
trách nhiệm hình sự dân sự hành chính phúc thẩm sơ thẩm giám đốc thẩm tái thẩm
ủy thác tư pháp tương trợ tư pháp cơ quan điều tra hội đồng xét xử quyết định
biên bản lệnh thông báo kết luận bản án thời hạn thời hiệu thẩm quyền
""".split()

# --- fixed values: acronyms, compared with case --------------------------------------
ACRONYMS = (
    "VKS", "VKSND", "VKSNDTC", "CQĐT", "CAND", "TAND", "TANDTC", "BLHS",
    "BLTTHS", "BLDS", "BLTTDS", "CCCD", "CMND", "UBND", "HĐND", "QĐ",
    "TTLT", "NĐ", "CP", "QH", "PDF", "DOCX", "TP", "KSND",
)

# --- fixed values: unit symbols, exempt after a number -------------------------------
UNITS = (
    "mm", "cm", "dm", "dam", "hm", "km", "in", "ft", "yd",
    "mm2", "cm2", "dm2", "m2", "km2", "mm3", "cm3", "dm3", "m3",
    "mcg", "μg", "µg", "mg", "kg", "ml", "cl", "dl",
    "ma", "ka", "mv", "kv", "mw", "kw", "hz", "khz", "mhz", "ghz",
    "pa", "kpa", "mpa", "bar", "kb", "mb", "gb", "tb",
)

# --- fixed values: role labels before a protected personal name ----------------------
ROLE_LABELS = ("ông", "bà", "anh", "chị", "bị can", "bị cáo", "bị hại", "đương sự", "nguyên đơn", "bị đơn")

# --- fixed values: issue kinds, severities and messages ------------------------------
KIND_PHRASE, KIND_FORMAT, KIND_SPELLING = "Cụm từ", "Trình bày", "Chính tả"
SEVERITIES = ("error", "warning", "style")
MESSAGE_PHRASE = "Cụm từ sai hoặc không phù hợp trong văn bản nghiệp vụ."
MESSAGE_SPELLING = "Từ không có trong từ điển tiếng Việt; cần kiểm tra lại."
MESSAGE_SPACES = "Có nhiều khoảng trắng liên tiếp."
MESSAGE_SPACE_BEFORE = "Có khoảng trắng thừa trước dấu câu."
MESSAGE_NO_SPACE_AFTER = "Thiếu khoảng trắng sau dấu câu."
MESSAGE_REPEATED = "Dấu câu bị lặp."
CONFIDENCE_PHRASE, CONFIDENCE_FORMAT = 99, 98
BODY_LOCATION = "Thân văn bản"

# --- fixed values: honorifics and roles before a personal name -----------------------
HONORIFICS = (
    "ông", "bà", "anh", "chị", "cô", "chú", "bác", "dì", "cậu",
    "thím", "em", "cháu", "ngài", "bị cáo", "bị can", "nguyên đơn",
    "bị đơn", "người bị hại", "người có quyền lợi, nghĩa vụ liên quan",
    "người làm chứng", "đương sự", "vợ", "chồng", "con trai", "con gái",
)

# --- fixed values: common surnames ---------------------------------------------------
SURNAMES = (
    "Nguyễn", "Trần", "Lê", "Phạm", "Hoàng", "Huỳnh", "Phan", "Vũ",
    "Võ", "Đặng", "Bùi", "Đỗ", "Hồ", "Ngô", "Dương", "Lý", "Đinh",
    "Đoàn", "Trịnh", "Mai", "Cao", "Tô", "Tạ", "Lâm", "Quách",
)

# --- fixed values: terms that are never part of a personal name ----------------------
NON_NAME_TERMS = (
    "bộ luật", "cộng hòa", "xã hội chủ nghĩa", "việt nam", "tòa án",
    "viện kiểm sát", "ủy ban", "hội đồng", "công an", "quyết định",
    "bản án", "thông báo", "biên bản", "nghị quyết", "điều luật",
    "blhs", "blds", "tand", "vksnd", "ubnd", "hđnd",
)

# --- fixed values: field labels of addresses and of what follows them ----------------
ADDRESS_LABELS = (
    "trú tại", "địa chỉ", "thường trú", "HKTT", "nơi ở", "chỗ ở", "nhà số",
    "nơi cư trú", "hộ khẩu thường trú",
)
ADDRESS_STOP_LABELS = ("số điện thoại", "điện thoại", "CCCD", "CMND", "sinh năm")

# --- fixed values: entity types and masks --------------------------------------------
TYPE_PHONE, TYPE_ID12, TYPE_ID9, TYPE_ADDRESS, TYPE_NAME = "SĐT", "CCCD", "CMND", "Địa chỉ", "Tên"
MASK_PHONE, MASK_NUMBER, MASK_ADDRESS, ALIAS_PREFIX, MASK_DEFAULT = (
    "[SĐT]", "[Số]", "Địa chỉ [Đã ẩn]", "Tên-", "[Ẩn]",
)
MAX_REPLACEMENTS, MAX_REPLACEMENT_LENGTH = 500, 500

# --- fixed values: file-name rules ---------------------------------------------------
MAX_STEM_LENGTH = 60
MAX_NAME_LENGTH, LONG_NAME_LENGTH = 100, 95
MAX_SUFFIX_TRIES = 100
SKIP_FOLDERS = (".git", "__pycache__", ".vscode", "node_modules", "chroma_law_db", "File_khong_loc_duoc")
ACCENTED_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
REASON_ACCENTS = "Ten co chua tieng Viet co dau"
REASON_LENGTH = "Ten qua dai ({length} ky tu, toi da {limit})"
REASON_SPECIAL = "Ten chua ky tu dac biet: "
REASON_SPACES = "Ten co nhieu khoang trang lien tiep"
REASON_UNDERSCORES = "Ten co nhieu dau gach duoi lien tiep"
ERROR_NO_FREE_NAME = "Khong the tao ten khong trung sau 100 lan thu"

# --- fixed values: abbreviations for file names --------------------------------------
ABBREVIATIONS = {
    "nghi dinh": "ND", "thong tu": "TT", "nghi quyet": "NQ", "quyet dinh": "QD",
    "chi thi": "CT", "hien phap": "HP", "bo luat": "BL", "luat": "L",
    "phap lenh": "PL", "van ban": "VB", "cong van": "CV", "thong bao": "TB",
    "huong dan": "HD", "quy che": "QC", "quy dinh": "QDinh", "dieu le": "DL",
    "tieu chuan": "TC", "quy chuan": "QChuan", "ke hoach": "KH", "bao cao": "BC",
    "to trinh": "TTr", "de an": "DA", "phuong an": "PA", "de nghi": "DN",
    "kien nghi": "KN", "khang nghi": "KNghi", "khieu nai": "KNai", "don": "Don",
    "bo": "Bo", "so": "So", "vien kiem sat": "VKS", "toa an": "TA",
    "uy ban": "UB", "hoi dong": "HDong", "chinh phu": "CP", "quoc hoi": "QH",
    "thu tuong": "TTg", "bo truong": "BT", "chu tich": "CTich", "vien truong": "VT",
    "chanh an": "CA", "tong cuc": "TCuc", "cuc": "Cuc", "chi cuc": "CCuc",
    "phong": "P", "ban": "Ban", "doan": "Doan", "to": "To", "doi": "Doi",
    "hinh su": "HS", "dan su": "DS", "hanh chinh": "HC", "kinh te": "KT",
    "lao dong": "LD", "dat dai": "DD", "hon nhan": "HN", "gia dinh": "GD",
    "thuong mai": "TM", "so huu tri tue": "SHTT", "moi truong": "MT",
    "giao thong": "GT", "xay dung": "XD", "y te": "YT", "giao duc": "GDuc",
    "tai chinh": "TCinh", "ngan hang": "NH",
    "sua doi": "SD", "bo sung": "BS", "huong dan thi hanh": "HDTH", "thi hanh": "TH",
    "pho bien": "PB", "giao duc phap luat": "GDPL", "phap luat": "PLuat",
    "to tung": "TTung", "xu phat": "XP", "vi pham": "VP", "boi thuong": "BTg",
    "tranh chap": "TChap", "khoi to": "KTo", "truy to": "TTo", "xet xu": "XXu",
    "tam giam": "TGiam", "tam giu": "TGiu", "bat": "Bat", "kham xet": "KXet",
    "thu giu": "TGu", "phong toa": "PToa", "ke bien": "KBien", "hoa giai": "HGiai",
    "trong tai": "TTai", "phuc tham": "PTham", "so tham": "STham",
    "giam doc tham": "GDT", "tai tham": "TTam",
    "cong hoa xa hoi chu nghia viet nam": "CHXHCNVN",
    "doc lap tu do hanh phuc": "DLTDHP", "phu luc": "PL", "mau": "M", "bieu mau": "BM",
}
#: date words dropped with their number when a name is still too long
DATE_WORDS = ("ngay", "thang", "nam")

# --- fixed values: preview classes by extension --------------------------------------
TEXT_EXTENSIONS = (
    ".txt", ".md", ".csv", ".log", ".json", ".xml", ".html", ".htm",
    ".py", ".js", ".ts", ".jsx", ".tsx", ".css", ".scss", ".less",
    ".ini", ".yml", ".yaml", ".cfg", ".conf", ".toml",
    ".sh", ".bat", ".ps1", ".vbs",
    ".sql", ".r", ".go", ".java", ".cpp", ".c", ".h", ".hpp",
    ".rust", ".rb", ".php", ".pl", ".lua", ".dart", ".swift",
    ".sln", ".csproj", ".props", ".targets",
    ".env", ".gitignore", ".gitattributes", ".editorconfig",
    ".rst", ".tex", ".bib",
    ".srt", ".vtt", ".sub",
)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".webp", ".ico")

# --- fixed values: page-document templates -------------------------------------------
MARKDOWN_EMPTY_PAGE = "*Không nhận dạng được văn bản*"
TEXT_EMPTY_PAGE = "[Khong nhan dang duoc van ban]"

# --- fixed values: day names, Sunday first -------------------------------------------
WEEKDAYS = ("Chủ nhật", "Thứ hai", "Thứ ba", "Thứ tư", "Thứ năm", "Thứ sáu", "Thứ bảy")


def rule_table(spark: SparkSession, rules, columns: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """A rule set as a DataFrame: a mapping gives two columns, a list gives one."""
    rows = list(rules.items()) if isinstance(rules, dict) else [(r,) for r in rules]
    schema = ", ".join(f"{c} string" for c in columns[: len(rows[0])])
    return spark.createDataFrame(rows, schema)
