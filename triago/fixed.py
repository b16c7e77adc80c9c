"""The shipped registry, extraction settings, prompts, messages and limits.

They are data that results depend on, kept together and as plain text. The vocabulary is French, as the documents are.
"""

from __future__ import annotations

# Limits.
AUTO_FILE_CONFIDENCE = 0.90
SURE, DOUBTFUL = 0.95, 0.60
OCR_DOCUMENT_MEAN = 0.80
OCR_LINE = 0.90
ARABIC_SHARE = 0.70
PAGE_VISIBLE_CHARS = 50
TITLE_LINES, TITLE_CHARS = 15, 1000
NAME_SIMILARITY = 0.80
TOKEN_CHARS, REPLY_TOKENS = 2.5, 400
TRUNCATED = "\n[... texte tronque ...]"
PATH_MAX, COMPONENT_MAX, DUPLICATE_ROOM, BASE_MIN = 259, 255, 4, 8
NEXT_LINE_DATE_CHARS = 40
RETENTION_DAYS = 7
OCR_PAGE_SECONDS = 60
TOLERANCE = "0.01"

# Folders and names.
REVIEW_FOLDER, OTHER_FOLDER, OTHER = "A_Valider", "Autres", "autres"
RESERVED_NAMES = ("a_valider", "autres")
ENGINE_OTHER = "autre"
IGNORED_FILES = ("desktop.ini", "thumbs.db", ".ds_store")
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp", ".docx", ".dotx", ".xls", ".xlsx")
DEVICE_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
PAGE_SEPARATOR, CELL_SEPARATOR = "\n\n", " | "
PERSON_FIELDS = ("titulaire", "beneficiaire", "personne", "parties")
SAFE_FOLDERS = ("folder_sortie", "folder_entree", "traites", "tests", "docs_test", "a_valider", "autres")
TOTAL_FIELDS = ("montant_ht", "tva", "montant_ttc")
MASK, FOUND, ABSENT, STARS = "[MASQUÉ]", "trouvé", "absent", "***"

# French months by their spellings, without accents.
MONTHS = {
    "janvier": 1, "janv": 1, "jan": 1, "fevrier": 2, "fevr": 2, "fev": 2, "mars": 3, "mar": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6,
    "juillet": 7, "juil": 7, "aout": 8, "septembre": 9, "sept": 9, "sep": 9, "octobre": 10, "oct": 10, "novembre": 11, "nov": 11, "decembre": 12, "dec": 12,
}

# Number words that keyword patterns must not hold.
NUMBER_WORDS = (
    "zero deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante "
    "cinquante soixante cent cents mille million millions milliard milliards"
).split()

# Patterns.
DATE_ISO = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
DATE_DIGITS = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?!\d)"
DATE_WORDS = r"(?<!\d)(\d{1,2})(?:er)?\s+([a-z]+)\.?\s+(\d{4}|\d{2})(?!\d)"
CURRENCY = r"(?:dirhams?|dhs?|mad|eur(?:os?)?|€)"
CURRENCY_AFTER = r"(?:dh|dhs|mad|dirhams?|eur|euros?|€)"
AMOUNT_GROUPED = r"-?\d{1,3}(?:[ \u00A0\u202F.,]\d{3})+(?:[.,]\d{1,2})?"
AMOUNT_PLAIN = r"-?\d+(?:[.,]\d{1,2})?"
OCR_LOOKALIKES = {"o": "[o0]", "i": "[i1l]", "l": "[l1i]", "s": "[s5]"}
DIGIT_LINE = r"[\d\s|/.\-]+"
ARABIC_LETTERS = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]"
CATEGORY_NAME = r"[a-z][a-z0-9_]*"
FOLDER_NAME = r"[A-Za-z][A-Za-z0-9_]*"
MASK_AFTER_ID = (
    r"(?i)(\b(?:c\.?\s?i\.?\s?n\b\.?|c\.?n\.?i\.?e\b\.?|carte\s+nationale(?:\s+d['’]\s?identit[eé](?:\s+[eé]lectronique)?)?)"
    r"(?:\s*(?::|n\s?[°º]|no\.?|num[eé]ro)\s*)*\s*)(?:(?:[a-z]{1,3}[\s.-]?)?\d(?:\s?\d)*|[^\s,;]+)"
)
MASKS = (
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    r"(?i)\bMA[\s.-]?\d(?:[\s.-]?\d){9,}",
    r"(?:\+|\b00)\s?212[\s.-]?(?:\(0\)|0)?[\s.-]?[5-7](?:[\s.-]?\d){8}(?!\d)",
    r"(?<!\d)0[5-7](?:[\s.-]?\d){8}(?!\d)",
    r"(?<!\d)\d(?: ?\d){23}(?!\d)",
    r"(?<!\d)\d(?: ?\d){7,}(?!\d)",
    r"\b[A-Za-z]{1,2}\d{5,}\b",
    r"\b[A-Z]{1,2} \d{5,}\b",
)
_LETTER, _APART = r"\p{L}\p{M}\p{Nd}\p{Pc}-", r"0-9A-Za-z_"
#: What is masked in running text: e-mails, long numbers, card numbers. Forms of phone and account numbers also fit the end of
#: one number and the start of the next (555-0612 53.12.34.56), and are for sentences that name such a number.
TEXT_MASKS = (
    rf"[{_LETTER}.+]++@[{_LETTER}]+(?:\.[{_LETTER}]+)+",
    r"[0-9](?: ?[0-9]){7,}",
    rf"(?<![{_APART}])[A-Za-z]{{1,2}}[0-9]{{5,}}(?![{_APART}])",
    rf"(?<![{_APART}])[A-Z]{{1,2}} [0-9]{{5,}}(?![{_APART}])",
)

# Messages. None holds a value of the document, but the gap of totals.
NO_DATE, MANY_DATES = "format non reconnu", "plusieurs dates differentes dans la meme valeur"
SHORT_YEAR, YEAR_RANGE, NO_DAY = "annee sur 2 chiffres, siecle deduit", "annee hors limites", "date impossible (jour ou mois hors calendrier)"
NO_AMOUNT, MIXED_SEPARATORS, AMBIGUOUS = "format non reconnu", "separateurs incoherents", "ambigu (separateur suivi de 3 chiffres)"
TOTALS_MISSING, TOTALS_TAX = "totaux : verification impossible (HT ou TTC manquant ou illisible)", "totaux : verification impossible (ligne de TVA illisible)"
TOTALS_NO_TAX, TOTALS_GAP, TOTALS_NO_TAX_GAP = "totaux : facture sans TVA", "totaux : HT + TVA different du TTC", "totaux : TVA manquante et HT different du TTC"
UNKNOWN_CATEGORY, NEEDS_REVIEW = "categorie absente du registre", "validation humaine necessaire"
NO_OCR, NOT_IN_SOURCE, ON_RECIPIENT, OUTSIDE_TITLE = "page non traitee", "valeur du moteur absente du texte source, rejetee", "valeur trouvee seulement sur une ligne de destinataire (client...), rejetee", "valeur hors de la zone titre, a verifier"

# The shipped registry.
REGISTRY = {
    "generic_fields": ["titre", "personne", "organisme", "date"],
    "sensitive_fields": ["cin", "rib", "iban", "date_naissance", "adresse"],
    "categories": [
        {
            "name": "factures", "folder": "Factures", "subfolders": [],
            "keywords": [r"\bfacture\b", r"\bnote d.honoraires\b", r"\btva\b", r"\bttc\b", r"\b(montant|total) ht\b"],
            "fields": ["fournisseur", "date_facture", "numero", "montant_ht", "tva", "montant_ttc", "ice"],
            "file_name": {"prefix": "facture", "parts": ["fournisseur", "date_facture", "numero"]},
        },
        {
            "name": "diplomes", "folder": "Diplomes",
            "subfolders": [
                {"name": "DEUG", "keywords": [r"\bdeug\b", r"\bdiplome d.etudes universitaires generales\b"]},
                {"name": "Licence", "keywords": [r"\blicence\b", r"\blicence fondamentale\b", r"\blicence professionnelle\b", r"\blicence d.etudes fondamentales\b"]},
                {"name": "Master", "keywords": [r"\bmaster\b", r"\bmaster specialise\b", r"\bmaster de recherche\b"]},
                {"name": "Doctorat", "keywords": [r"\bdoctorat\b"]},
                {"name": "Autres", "keywords": []},
            ],
            "keywords": [
                r"\bdiplome\b", r"\b(deug|master|doctorat|baccalaureat)\b", r"\blicence\s+(fondamentale|professionnelle|d.etudes|en)\b|\bdiplome\s+de\s+licence\b",
                r"\bmention\b", r"\b(confere|decerne)\b", r"\bgrade\b",
            ],
            "fields": ["titulaire", "intitule", "etablissement", "date_obtention", "mention"],
            "file_name": {"prefix": "diplome", "parts": ["sous_dossier", "titulaire"]},
        },
        {
            "name": "attestations", "folder": "Attestations",
            "subfolders": [
                {"name": "Travail", "keywords": [r"\battestation de travail\b"]},
                {"name": "Scolarite", "keywords": [r"\b(attestation|certificat) de scolarite\b"]},
                {"name": "Autres", "keywords": []},
            ],
            "keywords": [r"\battestation\b", r"\b(atteste|certifie)\b", r"\bpour servir et valoir\b", r"\battestation de travail\b", r"\bde (scolarite|salaire)\b"],
            "fields": ["emetteur", "beneficiaire", "objet", "date"],
            "file_name": {"prefix": "attestation", "parts": ["sous_dossier", "beneficiaire"]},
        },
        {
            "name": "contrats", "folder": "Contrats", "subfolders": [],
            "keywords": [r"\bcontrat\b", r"\bentre les soussignes\b", r"\barticle \d+\b", r"\bles parties\b", r"\bcontrat de travail\b"],
            "fields": ["parties", "objet", "date_signature", "duree"],
            "file_name": {"prefix": "contrat", "parts": ["objet", "date_signature"]},
        },
        {
            "name": "banque", "folder": "Banque", "subfolders": [],
            "keywords": [r"\breleve de compte\b", r"\bextrait de compte\b", r"\breleve d.identite bancaire\b", r"\bsolde\b"],
            "fields": ["banque", "titulaire", "periode", "objet", "rib", "iban"],
            "file_name": {"prefix": "banque", "parts": ["banque", "periode"]},
        },
    ],
    "rules": [
        {
            "description": "Une attestation de reussite d'un diplome est un diplome",
            "patterns": [r"\battestation de reussite\b", r"\b(diplome|deug|licence|master|doctorat|baccalaureat)\b"], "category": "diplomes",
        },
        {
            "description": "Un releve d'identite bancaire ou une attestation de RIB est un document bancaire",
            "patterns": [r"\b(releve d.identite bancaire|attestation de rib)\b"], "category": "banque",
        },
    ],
}

# Labelled fields. type: date, amount, text or digits; choice: first, last or sum.
FIELDS = {
    "numero": {
        "type": "text", "choice": "first",
        "labels": [r"\bfacture\s+n\s?[°º]\s*:?", r"(?<![a-z])n\s?[°º]\s*(?:de\s+(?:la\s+)?)?(?:facture)?\s*:?"],
        "value": r"(?:[A-Za-z/._-]{0,6}[0-9][A-Za-z0-9/._-]*|[A-Z]{1,3}(?= [A-Za-z/._-]{0,6}[0-9]))(?: (?:[A-Za-z/._-]{0,6}[0-9][A-Za-z0-9/._-]*|[/._-]{1,3}|[A-Z]{1,3}(?= [A-Za-z/._-]{0,6}[0-9])))*",
    },
    "date_facture": {"type": "date", "choice": "first", "labels": [r"\bdate\s+(?:de\s+(?:la\s+)?)?facture\s*:?", r"\bdate\s*:?"]},
    "date": {"type": "date", "choice": "first", "labels": [r"\bdate\s*:?", r"\bfait\s+a\s+[^,]{1,40},?\s+le\b", r"\ble\b"]},
    "date_signature": {"type": "date", "choice": "last", "labels": [r"\bdate\s+de\s+signature\s*:?", r"\bsigne\s+le\b", r"\bfait\s+a\s+[^,]{1,40},?\s+le\b"]},
    "date_obtention": {"type": "date", "choice": "first", "labels": [r"\bdate\s+d.obtention\s*:?", r"\bobtenu\s+le\b", r"\bdelivre\s+le\b", r"\bfait\s+a\s+[^,]{1,40},?\s+le\b"]},
    "date_naissance": {"type": "date", "choice": "first", "labels": [r"\bdate\s+de\s+naissance\s*:?", r"\bne(?:e|\(e\))?\s+le\b"]},
    "montant_ht": {"type": "amount", "choice": "last", "labels": [r"\b(?:total|montant)\s*h\.?\s?t\.?(?![a-z])"]},
    "tva": {
        "type": "amount", "choice": "sum", "ignore": r"\d+(?:[.,]\d+)?\s*%",
        "labels": [r"\b(?:total|montant)\s+(?:de\s+(?:la\s+)?)?t\.?v\.?a\.?(?![a-z])", r"\bt\.?v\.?a\.?(?![a-z])"],
    },
    "montant_ttc": {"type": "amount", "choice": "last", "labels": [r"\b(?:total|montant)\s*t\.?\s?t\.?\s?c\.?(?![a-z])", r"\bnet\s+a\s+payer(?:\s+ttc)?"]},
    "ice": {"type": "digits", "choice": "first", "labels": [r"\bi\.?c\.?e\.?(?![a-z])\s*:?"], "value": r"\d(?: ?\d){14}(?!\d)", "length": 15},
    "rib": {
        "type": "digits", "choice": "first", "length": 24, "more_lines": 4,
        "labels": [r"\breleve\s+d.identite\s+bancaire\s*:?", r"\br\.?i\.?b\.?(?![a-z])\s*:?"],
        "value": r"(?<!\d)\d{3}[\s|/.-]*\d{3}[\s|/.-]*\d{16}[\s|/.-]*\d{2}(?!\d)|\d(?:[ .-]?\d){23}(?!\d)",
    },
    "iban": {"type": "text", "choice": "first", "labels": [r"\biban\s*:?"], "value": r"[A-Za-z]{2} ?\d{2}(?: ?[A-Za-z0-9]){10,30}", "no_spaces": True},
    "cin": {
        "type": "text", "choice": "first", "no_spaces": True,
        "labels": [r"\bcarte\s+nationale(?:\s+d.identite)?(?:\s+electronique)?\s*(?:n\s?[°º])?\s*:?", r"\b(?:c\.?i\.?n\.?e?|cnie)(?![a-z])\s*(?:n\s?[°º])?\s*:?"],
        "value": r"[A-Za-z]{1,2} ?\d{4,7}(?!\d)",
    },
}

# Fields that an engine may fill, their prompt lines and their checks.
FREE_FIELDS = {
    "fournisseur": "nom de l'entreprise ou de la personne qui émet la facture",
    "titulaire": "nom de la personne à qui le document est délivré",
    "beneficiaire": "nom de la personne concernée par le document",
    "objet": "objet du document, en quelques mots",
    "etablissement": "établissement qui délivre le diplôme",
    "intitule": "intitulé du diplôme",
    "mention": "mention obtenue",
    "emetteur": "organisme ou personne qui délivre le document",
    "parties": "noms des parties signataires",
    "banque": "nom de la banque",
    "titre": "titre du document",
    "personne": "nom de la personne principale concernée",
    "organisme": "organisme qui émet le document",
    "duree": "durée du contrat, telle qu'écrite",
    "periode": "période couverte par le document, telle qu'écrite",
    "adresse": "adresse postale de la personne ou de l'organisme principal du document",
}
FREE_FIELD_CHECKS = {
    "fournisseur": {
        "not_on": [r"\bclient\b", r"\bdestinataire\b", r"\bfacture\s+a\b", r"\bdoit\b", r"\ba\s+l.attention\s+de\b", r"\badresse\s+a\b"],
        "in_title": True,
    }
}

# Machine profiles.
PROFILES = {
    "modest": {"ocr_threads": 2, "ocr_worker_mb": 1536, "model": "phi4-mini", "num_gpu": 0, "num_ctx": 2048, "timeout_s": 300, "ocr_and_llm": False},
    "fast": {"ocr_threads": 6, "ocr_worker_mb": 4096, "model": "phi4-mini", "num_gpu": 99, "num_ctx": 4096, "timeout_s": 120, "ocr_and_llm": True},
}

# Prompts.
PROMPTS = {
    "classification": (
        "Tu classes des documents administratifs en français pour un cabinet comptable.\n\nCatégories possibles :\n$categories\n"
        "- autre : le document ne correspond à aucune de ces catégories\n\nRègles :\n$regles\n"
        "- Un document qui MENTIONNE un diplôme, une facture ou un contrat n'est pas forcément de ce type : choisis la catégorie "
        "seulement si le document EST ce type. Sinon réponds autre et propose un nom.\n\nRéponds uniquement en JSON :\n"
        "- type_document : exactement une des catégories ci-dessus, ou « autre »\n- nom_propose : si type_document vaut « autre », "
        "un nom court (1 à 3 mots) décrivant ce type de document ; sinon null\n\nDOCUMENT :\n<<<\n$texte\n>>>\n"
    ),
    "extraction": (
        "Tu lis un document administratif en français (catégorie : $categorie).\n\nInformations à extraire :\n$champs\n\nRègles :\n"
        "- Recopie chaque valeur EXACTEMENT comme elle est écrite dans le document, avec les mêmes mots.\n"
        "- Si une information n'est pas dans le document, réponds null. N'invente jamais, ne déduis rien.\n"
        "- Ne donne que les informations demandées.\n\nRéponds uniquement en JSON, avec exactement ces clés.\n\nDOCUMENT :\n<<<\n$texte\n>>>\n"
    ),
    "keywords": (
        "Tu aides à créer une nouvelle catégorie de documents administratifs en français : « $categorie ».\n\n"
        "Propose de 3 à 5 mots ou expressions courtes (1 à 4 mots) qui apparaissent dans ce type de document et permettent de le reconnaître.\n\n"
        "Règles :\n- Recopie des mots qui sont écrits dans le document ci-dessous.\n- Jamais de nom de personne, jamais de nom de société, "
        "jamais de numéro ni de montant.\n- Des mots typiques du TYPE de document (titre, rubriques), pas des informations propres à ce document.\n\n"
        'Réponds uniquement en JSON : {"mots_cles": ["...", "..."]}\n\nDOCUMENT :\n<<<\n$texte\n>>>\n'
    ),
}
