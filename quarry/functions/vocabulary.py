"""Word lists, markers and patterns that results depend on."""

from __future__ import annotations

ZERO_WIDTH = "[​-‏‪-‮⁠﻿]"
DASHES = "‐‑‒–—―−﹘﹣－"

# Stop words of questions.
STOPWORDS = (
    "ai", "bao", "bằng", "bị", "các", "cái", "cho", "có", "của", "đã", "đang", "đâu", "đây", "đó", "được", "gì", "hay", "khi", "là", "làm", "mà",
    "một", "nào", "này", "như", "những", "phải", "ra", "sao", "sẽ", "theo", "thì", "thế", "trong", "trên", "từ", "và", "về", "việc", "với",
)

# Abbreviations and the words they stand for.
ABBREVIATIONS = {
    "bhxh": "bảo hiểm xã hội",
    "bhyt": "bảo hiểm y tế",
    "bhtn": "bảo hiểm thất nghiệp",
    "hđlđ": "hợp đồng lao động",
    "nld": "người lao động",
    "nlđ": "người lao động",
    "nsdld": "người sử dụng lao động",
    "nsdlđ": "người sử dụng lao động",
    "tnlđ": "tai nạn lao động",
    "pccc": "phòng cháy chữa cháy",
    "ubnd": "ủy ban nhân dân",
    "hđnd": "hội đồng nhân dân",
    "gplx": "giấy phép lái xe",
    "atgt": "an toàn giao thông",
    "qsdđ": "quyền sử dụng đất",
    "bđs": "bất động sản",
}

# Lines that name a type of document.
DOCUMENT_TYPES = (
    "BỘ LUẬT", "CHỈ THỊ", "CÔNG VĂN", "HIẾN PHÁP", "HIỆP ĐỊNH", "HƯỚNG DẪN", "KẾ HOẠCH", "LUẬT", "NGHỊ ĐỊNH", "NGHỊ QUYẾT", "PHÁP LỆNH", "QUY CHẾ",
    "QUYẾT ĐỊNH", "THÔNG BÁO", "THÔNG TƯ", "THÔNG TƯ LIÊN TỊCH", "TIÊU CHUẨN QUỐC GIA", "QUY CHUẨN KỸ THUẬT QUỐC GIA",
)
CONTENTS = ("MỤC LỤC", "TABLE OF CONTENTS")
REFERENCES = ("THƯ MỤC TÀI LIỆU THAM KHẢO", "TÀI LIỆU THAM KHẢO")
PREAMBLES = ("Căn cứ ", "Theo đề nghị ", "Xét đề nghị ", "QUYẾT NGHỊ", "QUYẾT ĐỊNH:")
# What ends a standard's Vietnamese title, and what a heading in capitals holds if it is one.
ENGLISH_MARKERS = (" Conformity assessment", " Requirements for", " Specification for", " Test methods")
TITLE_MARKERS = ("YÊU CẦU", "QUY ĐỊNH", "HƯỚNG DẪN", "ĐÁNH GIÁ", "AN TOÀN")

# Tags of structured chunks, by field.
TITLE_TAGS = ("VĂN BẢN", "TIÊU ĐỀ CHÍNH THỨC", "TIÊU ĐỀ SINH", "TIÊU ĐỀ GỢI Ý")
NUMBER_TAGS = ("SỐ/KÝ HIỆU",)
HIERARCHY_TAGS = ("PHÂN CẤP", "CHỦ ĐỀ/ĐIỀU MỤC", "TỪ KHÓA")
BODY_TAGS = ("NỘI DUNG",)

# Structural lines; the label and what follows are groups of the same names.
LABEL = "[IVXLCDM0-9]+[A-Za-zĐđ]?"
AFTER = r"(?:\s*[\-–—:.)]\s*|\s+)?"
CHAPTER = rf"^(PHẦN|Phần|CHƯƠNG|Chương)\s+({LABEL}){AFTER}(.*)$"
SECTION = rf"^(MỤC|Mục|TIỂU MỤC|Tiểu mục)\s+({LABEL}){AFTER}(.*)$"
ARTICLE = rf"^(ĐIỀU|Điều)\s+([0-9]+[A-Za-zĐđ]?){AFTER}(.*)$"
APPENDIX = rf"^(PHỤ\s+LỤC|Phụ\s+lục)\s*([IVXLCDM0-9A-Za-zĐđ.-]*){AFTER}(.*)$"
NUMERIC = r"^([0-9]+(?:\.[0-9]+){1,5})\.?\s+(.+)$"
CLAUSE = r"^([0-9]+[A-Za-zĐđ]?)\.\s+(.+)$"
POINT = r"^([A-Za-zĐđ])\s*[).]\s+(.+)$"
ROMAN = r"^([IVXLCDM]{1,8})\.\s+(.+)$"
BULLET = r"^([-–—•+])\s+(.+)$"
ELLIPSIS = r"^(?:\.{3,}|…+)(?:\s+(?:\.{3,}|…+))*$"

# Document numbers, in order of preference.
CODE = "[A-ZÀ-ỸĐ0-9.-]+(?:-[A-ZÀ-ỸĐ0-9.-]+)*"
NUMBERS = (
    rf"\bSố\s*:\s*([0-9]+(?:/[0-9]{{2,4}})?/{CODE})",
    r"\b(TCVN\s+(?:ISO(?:/IEC)?\s+)?[0-9]+(?::[0-9]{4})?)\b",
    rf"\b([0-9]+/[0-9]{{4}}/{CODE})\b",
)
# What a text with such a number has, as patterns that are quick to look for.
NUMBERS_MAY = ("(?iu)số", "(?i)tcvn", "[0-9]/[0-9]{4}/")
QUERY_NUMBER = (
    r"(?<!\w)(?:TCVN\s+(?:ISO(?:/IEC)?\s+)?[0-9]+(?:-[0-9]+)*(?:\s*:\s*[0-9]{4})?"
    rf"|QCVN\s*[0-9]{{1,3}}(?:-[0-9]+)?\s*:\s*[0-9]{{2,4}}(?:\s*/\s*[0-9A-ZÀ-ỸĐ]+(?:\s*[-.{DASHES}]\s*[0-9A-ZÀ-ỸĐ]+)*)?"
    rf"|[0-9]{{1,4}}\s*/\s*[0-9]{{4}}\s*/\s*[0-9A-ZÀ-ỸĐ]+(?:\s*[-.{DASHES}]\s*[0-9A-ZÀ-ỸĐ]+)*)"
)
REFERENCE = r"\b(điều|khoản|điểm|chương|mục|phụ\s+lục)\s+([0-9]+[a-zđ]?|[ivxlcdm]+)(?:\s*[.)])?"
IN_WORDS = r"ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{4})"
IN_FORCE = r"có\s+hiệu\s+lực(?:\s+thi\s+hành)?(?:\s+kể\s+từ)?\s+"
IN_DIGITS = r"ngày\s+([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})"
YEAR = r"(?<![0-9])(19[5-9][0-9]|20[0-3][0-9])(?![0-9])"

# Authorities, and lines next to them that are none.
UNDER = r"(?:\s+[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ\s,&/-]*)?"
AUTHORITY = (
    "^(?:QUỐC HỘI|CHÍNH PHỦ|THỦ TƯỚNG CHÍNH PHỦ|CHỦ TỊCH NƯỚC|TÒA ÁN NHÂN DÂN TỐI CAO|VIỆN KIỂM SÁT NHÂN DÂN TỐI CAO|KIỂM TOÁN NHÀ NƯỚC|"
    f"BỘ{UNDER}|HỘI ĐỒNG NHÂN DÂN{UNDER}|ỦY BAN NHÂN DÂN{UNDER})$"
)
STATE, MOTTO = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "ĐỘC LẬP - TỰ DO - HẠNH PHÚC"

# Words that make the text after an article's number its body, not its title.
BODY_MARKERS = ("ban hành kèm theo", "có hiệu lực", "chịu trách nhiệm", "quy định rằng", "giao ")
NUMERIC_MARKERS = (" Tiêu chuẩn này ", " Quy chuẩn này ", " Việc ", " Tổ chức ", " CHÚ THÍCH")

# Types of question, first match first.
QUESTION_TYPES = (
    ("yes_no", r"\bkhông\s*\?|\bhay\s+không\b|\bcó\b.*\bkhông\b"),
    ("when", "khi nào|bao giờ|lúc nào|thời điểm nào|ngày nào|năm nào|tháng nào"),
    ("where", "ở đâu|tại đâu|nơi nào|địa điểm nào"),
    ("who", r"\bai\b|người nào"),
    ("how", "làm sao|như thế nào|thế nào|cách nào|bằng cách nào"),
    ("which", r"(?:loại|kiểu|hình thức|cơ quan|tổ chức|văn bản|mức|cấp)\s+.{0,20}?nào"),
    ("what", r"là gì|\bgì\b|\bnào\b"),
)

# Weights of the rank fusion, by source.
FUSION_WEIGHTS = {"bm25": 0.20569207290714128, "vae": 0.3981416769041782, "bgem3": 0.15407202701928358, "f2llm": 0.2420942231693969}
