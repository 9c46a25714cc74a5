"""Patterns, word lists and labels that results depend on."""

# Detection rules, as data: name, pattern (Java syntax), level. Order is priority.
CATEGORIES = [
    ("CPF", r"\d{3}\.\d{3}\.\d{3}-\d{2}", "restrito"),
    ("RG", r"\b\d{1,2}\.\d{3}\.\d{3}-[\dXx]\b", "restrito"),
    ("TELEFONE", r"\(?\d{2}\)?[\s.-]?9?\d{4}[\s.-]?\d{4}", "restrito"),
]

# Act types in order of priority.
ACT_TYPES = {
    "Portaria": r"\bPORTARIA\b",
    "Decreto": r"\bDECRETO\b",
    "Edital": r"\bEDITAL\b",
    "Lei": r"\bLEI\s+(?:MUNICIPAL\s+)?N[ºO°]",
    "Resolução": r"\bRESOLU[ÇC][ÃA]O\b",
    "Aviso": r"\bAVISO\b",
    "Ofício": r"\bOF[ÍI]CIO\b",
    "Homologação": r"\bHOMOLOGA[ÇC][ÃA]O\b",
    "Extrato de Contrato": r"\bEXTRATO DE (?:CONTRATO|TERMO)\b",
}

CRITERIA = [
    (1, "valores_financeiros", 1, True),
    (2, "contratacao_licitacao", 1, True),
    (3, "nomeacao_exoneracao", 1, True),
    (4, "penalidade_beneficio", 1, True),
]

CRITERION_LABELS = {
    "valores_financeiros": "Valores financeiros",
    "contratacao_licitacao": "Contratação / licitação",
    "nomeacao_exoneracao": "Nomeação / exoneração",
    "penalidade_beneficio": "Penalidade / benefício",
}

METHOD_LABELS = {"ocr": "Extraído via OCR", "ocr_baixa_confianca": "OCR de baixa confiança"}

# Upper-case names: the pattern, joining words, and words of institutions.
UPPER_NAME = r"\b[A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{1,}){1,5}\b"
CONNECTORS = ["DA", "DE", "DO", "DOS", "DAS", "E"]
INSTITUTIONS = [
    "PREFEITURA", "MUNICIPAL", "MUNICIPIO", "SECRETARIA", "GOVERNO", "ESTADO", "DEPARTAMENTO", "DIRETORIA",
    "COORDENADORIA", "SUPERINTENDENCIA", "PROCURADORIA", "DIARIO", "OFICIAL", "PORTARIA", "DECRETO", "EDITAL",
    "PODER", "EXECUTIVO", "LEGISLATIVO", "CAMARA", "GABINETE", "ADMINISTRACAO", "FUNDACAO", "AUTARQUIA",
    "COMPANHIA", "INSTITUTO", "CONSELHO", "COMISSAO", "TRIBUNAL", "MINISTERIO",
]

PLACEHOLDER = r"\[[A-Z]+_[A-Z]+\]"
BROKEN_HYPHEN = r"(?<=[a-zà-ú])-\s*\n\s*(?=[a-zà-ú])"
BLANK_FIELD = r"[_.\-]{4,}"
FIELD_MARK = "[CAMPO]"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-ZÀ-Ú0-9\[])"
PAGE_MARK = r"<<PAGINA:(\d+)>>"
TABLE_MARK = "\n\n[TABELA]\n"
ACT_HEADING = r"(?iu)(?<!\b(?:a|o|d[ao]|pel[ao]|n[ao]|conforme)\s)\b(?:DECRETO|PORTARIA|EDITAL|RESOLU[ÇC][ÃA]O|ANEXO|OF[ÍI]CIO|AVISO|EXTRATO\s+DE\s+(?:CONTRATO|TERMO)|HOMOLOGA[ÇC][ÃA]O)\s+N[ºO°]?\s*[\d\.]+"
ARTICLE = r"\bArt\.\s*\d+"
TITLE_PREFIX = r"(?iu)^(DECRETO|PORTARIA|LEI(?:\s+MUNICIPAL)?|EDITAL|RESOLU[ÇC][ÃA]O|ANEXO|OF[ÍI]CIO|AVISO|EXTRATO)\b"
DEFAULT_TITLE = "Diário Oficial"

# Thresholds of extraction, quarantine, chunks, boilerplate and score tiers.
MIN_PAGE_CHARS, MIN_LETTER_RATIO = 40, 0.5
EMPTY_BELOW, SHORT_BELOW, LOW_CONFIDENCE_SHARE = 100, 300, 0.8
CHUNK_CHARS, MIN_CHUNK_CHARS = 2000, 80
BOILERPLATE_DOCS, FORM_FIELDS, FORM_DENSITY = 5, 4, 0.15
HIGH_TIER, MIDDLE_TIER = 0.7, 0.35
RRF_K, LEG_LIMIT = 60, 30
