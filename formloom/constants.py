"""Word lists, labels, patterns and thresholds of the data model.

These must hold the stated values for results to be right; nothing here is logic.
"""

from __future__ import annotations

# fixed values: text ----------------------------------------------------------

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ASCII_DIGITS = "0123456789"

RESPONSE_KEYS = ("natural_text", "markdown", "text", "content", "result")
LINE_PREFIXES = ("Corrected line:", "Line:", "Text:", "OCR hint:")
STAMP_PHRASE = ("สำหรับเรียก", "เท่านั้น")

# white space and marks that don't count where a line is compared with a passage
PASSAGE_MARKS = "(?U)[\\s\u200b.,/#!$%^&*;:{}=\\-_`~()'\"\u201c\u201d\u2018\u2019\\[\\]<>?|\\\\\u2026]"

LEGAL_SIGNALS = (
    "พิพากษา", "จำเลย", "โจทก์", "ให้ชำระ", "ดอกเบี้ย", "ค่าเสียหาย", "ค่าขาดประโยชน์", "คดี", "ศาล", "บาท",
)
PICTURE_SIGNALS = (
    "ภาพนี้", "รายละเอียด", "ตราสัญลักษณ์", "สีดำและสีขาว", "องค์ประกอบ", "ตรงกลางภาพ", "ลักษณะ", "ประกอบด้วย",
)

# code page 874 by byte value 0x80..0xFF: the characters and their Latin-1 twins
_CP874 = {0x80: 0x20AC, 0x85: 0x2026, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
          0x96: 0x2013, 0x97: 0x2014}
_CP874.update({b: 0x0E00 + b - 0xA0 for b in range(0xA1, 0xFC) if b not in (0xDB, 0xDC, 0xDD, 0xDE)})
CP874_CHARS = "".join(chr(u) for u in _CP874.values())
CP874_AS_LATIN1 = "".join(chr(b) for b in _CP874)

# a block from a line starting <figure to the line starting </figure, or to the end
FIGURE_BLOCK = r"(?ims)^[ \t]*<figure[^\n]*$.*?(?:^[ \t]*</figure[^\n]*$|\z)"

# fixed values: categories and statuses --------------------------------------

DEFAULT_CATEGORY = "uncategorized"
FORM_CATEGORIES = ("tr", "tor_ror")
BUSY_STATUSES = ("cleaning", "ocr_running")
QUEUE_STATUSES = ("uploaded", "ocr_queued", "ocr_failed")
PENDING_STATUSES = ("uploaded", "ocr_queued", "cleaning", "ocr_running")
FORM_PIPELINE_VERSION = 80
OTHER_PIPELINE_VERSION = 71
REVIEW_VERSION = 9
MAX_FILES_PER_BATCH = 20
MAX_PAGES_PER_FILE = 50
MAX_RECORDS_PER_BATCH = 100
PDF_CONTENT_TYPES = ("", "application/pdf", "application/x-pdf", "application/octet-stream")
FAILED_PAGE_PREFIX = "[OCR failed"
BENIGN_REASON_PREFIXES = (
    "OCR quality looked usable after comparing",
    "No watermark was detected, so OCR used the original rendered page image",
    "The pipeline compared OCR models:",
)

# fixed values: Thai form -----------------------------------------------------

D = "[0-9๐-๙]"
PERSON_ID = rf"{D}-{D}{{4}}-{D}{{4,5}}-{D}{{1,2}}-{D}"
HOUSE_CODE = rf"{D}{{4}}-{D}{{6}}-{D}"
MONTHS = (
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน",
    "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม",
)
MONTH_PATTERN = "(?:" + "|".join(MONTHS) + ")"
THAI_DATE = rf"(?:วันที่\s*)?({D}{{1,2}})(?:\s+เดือน)?\s+({MONTH_PATTERN})(?:\s+พ\.ศ\.)?\s+({D}{{4}})"
HOUSE_NUMBER = rf"{D}+(?:/{D}+)?(?:\s*-\s*{D}+(?:/{D}+)?)?"
DECEASED_KEYWORDS = ("ตาย", "เสียชีวิต")
NATIONALITIES = ("ไทย", "จีน", "ลาว", "พม่า", "กัมพูชา", "มาเลเซีย", "เวียดนาม", "อินเดีย", "อเมริกัน", "ญี่ปุ่น")
GENDERS = ("ชาย", "หญิง")
HOUSE_STATUSES = ("ผู้อาศัย", "เจ้าบ้าน")
NAME_FORBIDDEN_VALUES = ("ชาย", "หญิง", "ไทย", "เจ้าบ้าน", "ผู้อาศัย")
NAME_FORBIDDEN_PARTS = ("table", "tbody", "tr", "td", "th")
NAME_FORBIDDEN_PLACES = ("อำเภอ", "จังหวัด", "แขวง", "ตำบล", "กรุงเทพ")
NOT_NAME_TOKENS = ("นาย", "นาง", "นางสาว", "เด็กชาย", "เด็กหญิง", "ชาย", "หญิง", "ไทย")
EMPTY_MARKS = ("-", "#", "##########")
MALE_TITLES = ("นาย", "เด็กชาย", "ด.ช.")
FEMALE_TITLES = ("นาง", "นางสาว", "น.ส.", "เด็กหญิง", "ด.ญ.")
PARENT_CROP_BLOCKED = (
    "ส่วนราชการ", "กรม", "กระทรวง", "สำนักงาน", "เลขที่", "วันที่", "ที่อยู่", "เบอร์โทรศัพท์", "อีเมล",
)
LABEL_NOISE = (
    "table name", "TT_UpTTR", "PIE", "PHIE", "PNBme", "PSDX", "PNbtionality", "PBE", "PAhe", "PAStatus", "MNBme",
    "MIE", "MNbtnionality", "DNBme", "DIE", "DNbtionality", "AEdress", "Address_In", "UpDate", "ID", "รหัสบ้าน",
    "ชื่อ", "เพศ", "สัญชาติ", "วันเกิด", "อายุ", "สถานภาพที่อยู่", "มารดา", "บิดา", "ที่อยู่", "เข้ามาอยู่วันที่",
    "Remark", "Update Date",
)
FIELD_LABEL_NOISE = {
    "personId": ("ID", "PIE"),
    "houseCode": ("รหัสบ้าน", "PHIE"),
    "personName": ("ชื่อ", "PNBme"),
    "gender": ("เพศ", "PSDX"),
    "nationality": ("สัญชาติ", "PNbtionality"),
    "birthDate": ("วันเกิด", "PBE"),
    "age": ("อายุ", "PAhe"),
    "status": ("สถานภาพที่อยู่", "PAStatus"),
    "motherName": ("มารดา", "MNBme"),
    "motherId": ("ID", "MIE"),
    "motherNationality": ("สัญชาติ", "MNbtnionality"),
    "fatherName": ("บิดา", "DNBme"),
    "fatherId": ("ID", "DIE"),
    "fatherNationality": ("สัญชาติ", "DNbtionality"),
    "address": ("ที่อยู่", "AEdress"),
    "postalCode": ("รหัสไปรษณีย์", "PPstalCode", "Postal Code"),
    "moveInDate": ("เข้ามาอยู่วันที่", "Address_In"),
    "remark": ("Remark",),
    "updateDate": ("Update Date", "UpDate"),
}
# labels printed on the page and the field that each one opens
PAGE_LABELS = (
    ("เลขประจำตัวประชาชน", "personId"), ("เลขรหัสประจำบ้าน", "houseCode"), ("ชื่อ", "personName"), ("เพศ", "gender"),
    ("สัญชาติ", "nationality"), ("เกิดเมื่อ", "birthDate"), ("อายุ", "age"), ("สถานภาพ", "status"), ("มารดาชื่อ", "motherName"),
    ("บิดาชื่อ", "fatherName"), ("ที่อยู่", "address"), ("เข้ามาอยู่เมื่อวันที่", "moveInDate"), ("บันทึกเพิ่มเติม", "remark"),
    ("ปรับปรุงครั้งสุดท้าย", "updateDate"),
)
# labels that may follow another label's value on the same line, and those whose value is the rest of the line
INLINE_LABELS = ("เพศ", "สัญชาติ", "อายุ")
WHOLE_LINE_LABELS = ("ที่อยู่", "บันทึกเพิ่มเติม")
# words that an address has right after its house number, and words that end the part about persons
ADDRESS_OPENERS = ("หมู่", "ซอย", "ถนน", "แขวง", "ต\\.", "ตำบล")
PERSONS_END = ("ท้องถิ่น", "บุคคลนี้", "สำหรับเจ้าหน้าที่")
DASHES = ("-", "–", "—")
REMARK_CUT_MARKERS = ("สำหรับเจ้าหน้าที่", "PageNumber", "Update Date")
REMARK_START_MARKERS = ("บุคคลนี้", "มีภูมิลำเนา", "อยู่ในบ้านนี้")
DOMICILE_REMARK = "บุคคลนี้มีภูมิลำเนาอยู่ในบ้านนี้"
ADDRESS_CUT_MARKERS = ("ท้องถิ่น", "บุคคลนี้", "Remark", "Update Date")
DATE_TOKEN_CORRECTIONS = (("พวภาคม", "พฤษภาคม"), ("พฤศภาคม", "พฤษภาคม"), ("พฤศจิกาคม", "พฤษภาคม"))
NAME_GLYPH_REPAIRS = (("ร์อ", "ร่อ"),)

# field key, page, box (left, top, right, bottom), id position
FIELD_TEMPLATES = (
    ("tableName", 1, None, None),
    ("personId", 1, (0.22, 0.252, 0.46, 0.286), 0),
    ("houseCode", 1, (0.59, 0.252, 0.82, 0.286), None),
    ("personName", 1, (0.13, 0.287, 0.43, 0.318), None),
    ("gender", 1, (0.47, 0.287, 0.55, 0.318), None),
    ("nationality", 1, (0.69, 0.287, 0.78, 0.318), None),
    ("birthDate", 1, (0.13, 0.322, 0.34, 0.355), None),
    ("age", 1, (0.34, 0.322, 0.43, 0.355), None),
    ("status", 1, (0.62, 0.322, 0.75, 0.36), None),
    ("motherName", 1, (0.13, 0.36, 0.32, 0.395), None),
    ("motherId", 1, (0.32, 0.372, 0.55, 0.397), 1),
    ("motherNationality", 1, (0.57, 0.36, 0.69, 0.395), None),
    ("fatherName", 1, (0.13, 0.397, 0.32, 0.43), None),
    ("fatherId", 1, (0.32, 0.407, 0.55, 0.432), 2),
    ("fatherNationality", 1, (0.57, 0.397, 0.69, 0.43), None),
    ("address", 1, (0.13, 0.43, 0.82, 0.47), None),
    ("postalCode", 1, None, None),
    ("moveInDate", 1, (0.13, 0.525, 0.60, 0.565), None),
    ("remark", 1, (0.13, 0.56, 0.58, 0.605), None),
    ("updateDate", 1, (0.42, 0.70, 0.86, 0.745), None),
)
# rows of the parents on the page, whichever of its slots a value is in
PARENT_ROWS = (("mother", (0.12, 0.352, 0.72, 0.389)), ("father", (0.12, 0.390, 0.72, 0.438)))
# how far a slot is widened, and which share of a segment has to lie in it
NAME_SLOT, ADDRESS_SLOT, OTHER_SLOT = (0.003, 0.45), (0.006, 0.45), (0.005, 0.30)
ROW_PAD, ROW_SLOT_PAD, ROW_SHARE = 0.002, 0.004, 0.35
NAME_FIELDS = ("personName", "motherName", "fatherName")
PARENT_NAMES = ("motherName", "fatherName")
ID_FIELDS = ("personId", "motherId", "fatherId")
DATE_FIELDS = ("birthDate", "moveInDate", "updateDate")
NATIONALITY_FIELDS = ("nationality", "motherNationality", "fatherNationality")
REQUIRED_FIELDS = (
    "personId", "houseCode", "personName", "gender", "nationality", "birthDate", "age", "status", "updateDate",
)
SUMMARY_FIELDS = (
    "personId", "houseCode", "personName", "gender", "nationality", "birthDate", "age", "status", "motherName",
    "motherId", "motherNationality", "fatherName", "fatherId", "fatherNationality", "address", "moveInDate",
    "remark", "updateDate",
)
CRITICAL_FIELDS = ("personName", "personId", "houseCode")
EMPTY_SOURCES = ("source_dash", "source_blank")
EXPORT_REQUIRED = ("personId", "houseCode", "personName")

# fixed values: judgments -------------------------------------------------------

BLACK_MARKERS = (
    "คดีหมายเลขดำที่", "คดีหมายเลขดำ", "หมายเลขดำที่", "หมายเลขดำ", "คดีดำเลขที่", "คดีดำที่", "คดีดำ",
)
RED_MARKERS = (
    "คดีหมายเลขแดงที่", "คดีหมายเลขแดง", "หมายเลขแดงที่", "หมายเลขแดง", "คดีแดงเลขที่", "คดีแดงที่", "คดีแดง",
)
COURT_ONLY_MARK = "สำหรับศาล"
AMOUNT = "([0-9๐-๙,\\.]+)"
PAY_PATTERNS = (
    rf"พิพากษาให้จำเลย(?:ที่\s*{D}+)?\s*ชำระเงิน(?:เป็น)?\s*จำนวน\s*{AMOUNT}",
    rf"พิพากษาให้จำเลย(?:ที่\s*{D}+)?\s*ชำระเงิน(?:เป็น)?\s*{AMOUNT}",
    rf"ชำระเงิน(?:เป็น)?\s*จำนวน\s*{AMOUNT}",
    rf"คืนไม่ได้ให้ใช้ราคาแทนเป็นเงิน(?:จำนวน)?\s*{AMOUNT}",
    rf"ใช้ราคาแทนเป็นเงิน(?:จำนวน)?\s*{AMOUNT}",
)
FILING_PATTERNS = (
    rf"(?:ฟ้อง|พ้อง)วันที่\s*({D}+\s+\S+\s+{D}+)",
    rf"วันฟ้อง\s*\(?\s*วันที่\s*({D}+\s+\S+\s+{D}+)",
)
INTEREST_PATTERNS = (rf"อัตราร้อยละ\s*{AMOUNT}", rf"รายละเอียด\s*{AMOUNT}\s*ต่อปี", rf"{AMOUNT}\s*ต่อปี")
PRINCIPAL_PATTERNS = (r"(?:ของต้นเงิน|ของเงินต้น)\s*([0-9๐-๙ด,\.]+)",)
FEE_PATTERNS = (rf"ค่าทนายความ\s*[\/\\|]?\s*{AMOUNT}",)

# fixed values: wording of the filing date
NEXT_DAY_PATTERNS = (
    r"นับถัดจากวันฟ้อง\s*\(\s*ฟ้องวันที่\s*([^)]{4,80})\s*\)",
    r"นับถัดจากวันฟ้อง\s*ฟ้องวันที่\s*([^()]{4,80})",
    r"นับถัดจากวันฟ้อง\s*\(?([^()]{4,80})\)?\s*เป็นต้นไป",
)
SAME_DAY_PATTERNS = (
    r"วันฟ้อง\s*\(\s*ฟ้องวันที่\s*([^)]{4,80})\s*\)",
    r"ฟ้องวันที่\s*([^()]{4,80})\s*(?:เป็นต้นไป|$)",
    r"วันฟ้อง\s*\(?([^()]{4,80})\)?\s*เป็นต้นไป",
)

# fixed values: case numbers, evidence for them, and where a judgment's text starts and ends
CASE_SERIES, MISREAD_SERIES = "ผบ", "พบ"
METHOD_BONUS = (("full_page_ocr", 0.5), ("ocr_crop", 0.7), ("vision_crop", 0.6))
PAIR_BONUS = ((("full_page_ocr", "ocr_crop"), 1.3), (("ocr_crop", "vision_crop"), 0.9))
SUPPORT_BONUS, PREVIEW_BONUS, ORIGINAL_BONUS = 2.3, 1.8, 0.2
LATIN_CASE_SERIES = r"[A-Za-z][0-9๐-๙]{3,}/[0-9๐-๙]{2,4}"
JUDGMENT_KEYWORDS = ("พิพากษาให้จำเลย", "ชำระเงิน", "ค่าทนายความ")
JUDGMENT_STARTS = ("คำพิพากษา", "พิพากษาให้จำเลย", "พิพากษาให้จำเลบย")
JUDGMENT_ENDS = ("ค่าใช้จ่ายในการดำเนินคดีให้เป็นพับ./", "ให้เป็นพับ./", "เป็นพับ./", "พับ./")
JUDGMENT_LOOSE_ENDS = (
    "ค่าใช้จ่ายในการดำเนินคดีให้เป็นพับ", "ค่าใช้จ่ายในการดำเนินคดีให้เป็บพับ", "ให้เป็นพับ", "ให้เป็บพับ", "เป็นพับ", "เป็บพับ",
)
JUDGMENT_NOISE = (
    "สำหรับเรียกตู้ข้อมูลเท่านั้น", "สำหรับเรียกคดีข้อมูลเท่านั้น", "สำหรับเรียกตู้ห้องเตาบั้น", "สำหรับศาลใช้",
)
JUDGMENT_STOPS = ("ผู้เขียน",)
CONTINUATION_NOISE = ("สำหรับ", "ศาลใช้", "สำหรับศาลใช้")
PASSAGE_SEGMENTS, PASSAGE_CHARS = 18, 1400
