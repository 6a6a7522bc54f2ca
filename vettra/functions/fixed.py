"""Fixed values that results must agree on."""

# fixed values: severities, their rank and their penalty in points
SEVERITIES = {"info": (0, 0.0), "low": (1, 6.0), "medium": (2, 18.0), "high": (3, 35.0), "critical": (4, 60.0)}
# fixed values: weights of the risk channels and thresholds of the decision
WEIGHTS = {"model": 0.55, "forensic": 0.25, "semantic": 0.15, "anomaly": 0.05}
GRAPH_OVERLAY, APPROVE_AT, FREEZE_BELOW, CRITICAL_CEILING, VERIFICATION_CAP = 0.5, 70.0, 40.0, 25.0, 25.0
# fixed values: affordability norms
FOIR_CAP, FOIR_REFER, ANNUAL_RATE, TENURE_MONTHS, LTV_CAP = 0.50, 0.60, 0.105, 60, 0.80
# fixed values: holder types by the fourth letter of a PAN
PAN_HOLDERS = {
    "P": "Individual", "C": "Company", "H": "HUF (Hindu Undivided Family)", "F": "Firm/LLP", "A": "Association of Persons",
    "T": "Trust", "B": "Body of Individuals", "L": "Local Authority", "J": "Artificial Juridical Person", "G": "Government",
}
# fixed values: published Verhoeff tables are generated from these
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
# fixed values: producers that no document-issuing system uses
SUSPICIOUS_PRODUCERS = ("photoshop", "ilovepdf", "pdfescape", "foxit", "inkscape", "gimp", "affinity", "scribus", "pixelmator")
# fixed values: image editors that no scan of a document names
EDITOR_SOFTWARE = (
    "photoshop", "gimp", "paint.net", "ms paint", "snapseed", "lightroom", "pixelmator", "affinity", "canva", "inkscape", "imagemagick", "picsart", "photopea", "acdsee", "corel",
    "skitch", "photoscape", "fotor", "luminar", "facetune",
)
# fixed values: honorifics before names
HONORIFICS = r"(?i)\b(mr|mrs|ms|smt|shri|sri|dr|kum|m/s)\.?\b"
# fixed values: classifier keywords with weights; classes in order of precedence
LEXICON = {
    "pan": {"permanent account number": 4, "income tax department": 2, "govt. of india": 1, "pan": 1},
    "aadhaar": {"aadhaar": 4, "unique identification authority": 4, "uidai": 4, "आधार": 3, "mera aadhaar": 2, "government of india": 1, "vid": 1},
    "form16": {"form no. 16": 4, "form 16": 4, "certificate under section 203": 3, "gross salary": 2, "tax deducted at source": 2, "part b": 1, "tds": 1, "traces": 2},
    "salary_slip": {"salary slip": 4, "pay slip": 4, "payslip": 4, "net pay": 2, "basic pay": 2, "earnings": 1, "deductions": 1, "hra": 1, "ctc": 1},
    "bank_statement": {"statement of account": 4, "bank statement": 4, "account statement": 3, "closing balance": 2, "ifsc": 2, "salary credit": 2, "withdrawal": 1, "deposit": 1, "upi": 1, "transaction": 1},
    "itr": {"indian income tax return": 4, "itr-v": 4, "itr v": 3, "acknowledgement number": 2, "assessment year": 1},
    "address_proof": {
        "electricity bill": 4, "utility bill": 4, "gas bill": 3, "water bill": 3, "telephone bill": 3, "broadband": 2, "passport": 4, "republic of india": 2, "voter": 3, "elector": 3,
        "electoral photo identity": 4, "driving licence": 4, "driving license": 4, "bill date": 1, "billing period": 1, "consumer no": 1, "service address": 1, "permanent address": 1,
    },
    "sale_deed": {"sale deed": 4, "sub-registrar": 2, "vendee": 1, "vendor": 1, "consideration": 1},
    "encumbrance_certificate": {"encumbrance certificate": 4, "nil encumbrances": 2, "registered transactions": 1},
    "property_valuation": {"valuation report": 4, "assessed market value": 3, "approved valuer": 2},
    "legal_opinion": {"legal opinion": 4, "title search": 2, "title is clear": 2, "advocate": 1},
}
# fixed values: slots of each purpose (required, optional), and the schema type of a slot where it differs
PROFILES = {
    "kyc": (("pan", "aadhaar", "address_proof"), ()),
    "salaried_loan": (("pan", "aadhaar", "address_proof", "salary_slip", "form16", "bank_statement"), ("itr",)),
}
SLOT_TYPES = {"pan": "identity", "aadhaar": "identity"}
# fixed values: label layouts of each document type, (kind, patterns in order of preference)
_PAN = r"[A-Z]{5}\d{4}[A-Z]"
FIELDS = {
    "identity": {"name": ("text", (r"Name:\s+(.+)",)), "pan": ("text", (rf"PAN:\s+({_PAN})",)), "dob": ("text", (r"Date of Birth:\s+(\S+)",))},
    "form16": {
        "name": ("text", (r"Employee:\s+(.+)", r"Name and address of the Employee\s*\n\s*(.+)")),
        "pan": ("last", (rf"PAN:\s+({_PAN})", _PAN)),
        "employer": ("text", (r"Employer:\s+(.+)", r"Name and address of the Employer\s*\n\s*(.+)")),
        "gross_income": ("money", (r"(?i)Gross Salary[^\n]*(?:\n[^\n]*)?\bRs\.\s*([\d,]+)", r"(?is)Gross Salary.*?Rs\.\s*([\d,]+)")),
        "tax_paid": ("money", (r"(?i)Tax Deducted[^\n]*(?:\n[^\n]*)?\bRs\.\s*([\d,]+)", r"(?is)Tax Deducted.*?Rs\.\s*([\d,]+)")),
        "fy": ("text", (r"FY\s+(\d{4}-\d{2})",)),
    },
    "salary_slip": {
        "name": ("text", (r"Employee:\s+(.+)", r"Employee Name:\s+(.+)")),
        "net_monthly": ("money", (r"(?i)Net Pay[^\n]*(?:\n[^\n]*)?\bRs\.\s*([\d,]+)", r"(?is)Net Pay.*?Rs\.\s*([\d,]+)")),
        "employer": ("text", (r"SALARY SLIP\s*\n(.+?)\s*\|", r"(.+?)\n[^\n]*\nPayslip for the month")),
    },
    "bank_statement": {
        "name": ("text", (r"Holder:\s+(.+)",)), "masked_account": ("text", (r"Account:\s+(\S+)",)),
        "salary_credits": ("moneys", (r"(?i)SALARY CREDIT[^\n]*Rs\.\s*([\d,]+)", r"(?i)SALARY CREDIT[^\n]*\n\s*Rs\.\s*([\d,]+)")),
    },
    "sale_deed": {
        "property_id": ("text", (r"Property No:\s+(\S+)",)), "property_address": ("text", (r"Property Addr:\s+(.+)",)), "owner_name": ("text", (r"Owner\s*\(Vendee\):\s+(.+)",)),
        "pan": ("text", (rf"PAN of Vendee:\s+({_PAN})",)), "consideration": ("money", (r"(?i)Consideration:\s*Rs\.\s*([\d,]+)",)),
    },
    "encumbrance_certificate": {
        "property_id": ("text", (r"Property:\s+(\S+)",)), "owner_name": ("text", (r"Owner:\s+(.+)",)), "property_address": ("text", (r"Property Addr:\s+(.+)",)),
        "period": ("text", (r"Period:\s+(\S+)",)), "claims_nil": ("flag", ("(?i)NIL ENCUMBRANCES",)),
    },
    "property_valuation": {
        "property_id": ("text", (r"Property No:\s+(\S+)",)), "property_address": ("text", (r"Property Addr:\s+(.+)",)), "owner_name": ("text", (r"Owner:\s+(.+)",)),
        "valuation_amount": ("money", (r"(?i)Assessed Market Value[^\n]*(?:\n[^\n]*)?\bRs\.\s*([\d,]+)", r"(?is)Assessed Market Value.*?Rs\.\s*([\d,]+)")),
    },
    "legal_opinion": {
        "property_id": ("text", (r"Property No:\s+(\S+)",)), "owner_name": ("text", (r"Owner examined:\s+(.+)",)), "advocate": ("text", (r"Advocate:\s+(.+)",)),
        "title_clear": ("flag", ("(?i)title is clear",)), "title_unclear": ("flag", ("(?i)title is NOT clear",)),
    },
    "address_proof": {
        "name": ("text", (r"(?i)(?:Consumer Name|Customer Name|Name of Consumer|Holder|Name)\s*[:\-]?\s*([A-Za-z][A-Za-z .]{2,})",)),
        "address": ("text", (r"(?i)(?:Service Address|Billing Address|Permanent Address|Address)\s*[:\-]?\s*(.+)",)),
        "issue_date": ("text", (r"(?i)(?:Bill Date|Date of Issue|Issue Date|Date)\s*[:\-]?\s*([0-3]?\d[/\-.][0-3A-Za-z]{1,9}[/\-.]\d{2,4})",)),
    },
}
CHARGE_PATTERN = r"(?i)mortgage in favour of ([^,\n]+),\s*Rs\.\s*([\d,]+),\s*registered\s+(\S+)"
BORN_PATTERN = r"(?i)(?:Date of Birth|DOB|D\.?O\.?B\.?)\s*[:\-]?\s*([0-3]?\d[/\-.][0-3A-Za-z]{1,9}[/\-.]\d{2,4})"
CARD_NAME_PATTERN = r"\bName\s*[:\-]?\s*([A-Za-z][A-Za-z .]+)"
# fixed values: rules in order of evaluation, (title, confidence); the words of the titles set the model's features
RULES = {
    "income_bank": ("Income declared on Form 16 inconsistent with bank credits", 0.90),
    "income_slip": ("Income declared on Form 16 inconsistent with salary slip", 0.90),
    "name": ("Applicant name inconsistency across documents", 0.90),
    "pan": ("PAN inconsistency across documents", 0.97),
    "owner": ("Sale deed owner does not match applicant", 0.88),
    "property": ("Property ID inconsistency across collateral documents", 0.90),
    "ltv": ("Abnormal loan-to-value ratio", 0.90),
    "valuation": ("Property valuation inflated above registry market value", 0.90),
    "loan": ("Loan exceeds registered market value (LTV vs registry > 100%)", 0.92),
    "encumbrance": ("Encumbrance certificate contradicts CERSAI registry", 0.95),
}
INCOME_TOLERANCE, INCOME_SEVERE, LTV_FLAG, INFLATION_FLAG, INFLATION_SEVERE = 0.20, 0.40, 0.90, 0.20, 0.40
# fixed values: words of titles that set a feature
FORENSIC_FLAGS = {"has_whitebox_edit": ("white", "covered"), "has_font_inconsistency": ("font",), "has_duplicate_image": ("duplicate", "copy"), "has_incremental_update": ("incremental",), "has_suspicious_metadata": ("suspicious", "future", "impossible", "modified long")}
SEMANTIC_FLAGS = {"has_income_inconsistency": ("income", "bank", "salary"), "has_property_irregularity": ("property", "valuation", "ltv", "loan-to-value", "registry"), "has_cersai_violation": ("cersai", "encumbrance")}
# fixed values: order of the model's features, and how evidence names them
FEATURES = {
    "n_forensic_total": "number of document tamper signals", "n_forensic_high_critical": "number of severe tamper signals", "has_whitebox_edit": "white-box / overwrite edit detected",
    "has_font_inconsistency": "inconsistent font in a key figure", "has_duplicate_image": "duplicated (copy-pasted) content", "has_incremental_update": "post-hoc incremental PDF revision",
    "has_suspicious_metadata": "suspicious authoring software or dates", "n_semantic_total": "number of cross-document inconsistencies", "has_income_inconsistency": "declared income vs bank/salary mismatch",
    "has_property_irregularity": "property valuation / ID / LTV irregularity", "has_cersai_violation": "undisclosed registered charge (CERSAI)", "submit_velocity_hours": "submission timing relative to document creation",
    "max_doc_gap_days": "spread of document creation dates", "all_docs_same_timestamp": "all documents share one creation timestamp", "creation_before_submission": "document dates inconsistent with submission", "doc_count": "packet document count",
}
# fixed values: body fonts that need no remark, and words of serif and sans names
BODY_FONTS = ("helv", "hebo", "cour", "timesroman", "courier", "helvetica")
SERIF_WORDS = ("tiro", "georgia", "times", "timesroman", "palatino", "garamond", "cambria")
SANS_WORDS = ("helv", "helvetica", "arial", "calibri", "verdana", "hebo")
FONT_SUFFIXES = ("bold", "italic", "oblique", "regular", "mt", "ps")
# fixed values: thresholds of noise loss and flat fill
NOISE_FLOOR, NOISE_LOW, NOISE_CELLS, NOISE_MOST, NOISE_REGIONS, NOISE_VALID = 2.2, 0.50, 5, 0.02, 3, 8
FILL_STD, FILL_LOW, FILL_HIGH, FILL_DELTA, FILL_CELLS, FILL_WHITE, FILL_MOST = 4.0, 70, 242, 12, 6, 0.30, 0.05
# fixed values: error levels and recompression ghosts: quality, robust factor, floor, least blocks; qualities, distance from the usual one, strength
ELA_QUALITY, ELA_FACTOR, ELA_FLOOR, ELA_CELLS = 90, 6.0, 14.0, 3
GHOST_QUALITIES, GHOST_APART, GHOST_STRENGTH = (55, 65, 75, 85, 95), 20.0, 0.4
# fixed values: copied regions: matches of each block, least shift, least matches of a shift, correlations of content and noise, half a window, largest share of the page
CLONE_NEIGHBOURS, CLONE_SHIFT, CLONE_MATCHES, CLONE_CONTENT, CLONE_NOISE, CLONE_REACH, CLONE_MOST = 3, 30, 10, 0.92, 0.30, 12, 0.06
# fixed values: tiles of learned masks: side, share of the stride, gate, threshold, least area
TILE_SIDE, TILE_STRIDE, TILE_GATE, MASK_AT, MASK_AREA = 384, 0.75, 0.5, 0.5, 256
# fixed values: detectors that read pixels
PIXEL_DETECTORS = ("ela", "noise", "flat_fill", "copy_move", "jpeg_ghost", "recapture")
# fixed values: names whose values are masked whole
PII_NAMES = ("name", "applicant_name", "owner_name", "borrower_name", "pan", "applicant_pan", "account_number", "account_numbers", "property_id", "address", "property_address")
# fixed values: extensions of images, and the visible characters from which a page or a document has a text layer
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
PAGE_TEXT, DOCUMENT_TEXT = 15, 10
