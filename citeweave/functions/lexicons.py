"""Word lists and lookup tables that retrieval results depend on, in their natural order."""

# ---- fixed values: law families -------------------------------------------------------------------------------------
FAMILIES_FIRST = ("STPO", "OR", "ZGB", "STGB", "BV", "AIG", "BGG", "ZPO", "SCHKG", "IPRG", "ATSG", "IVG")
FAMILIES_LAST = ("ZGB", "OR", "BGG", "STPO", "BV", "ZPO", "SVG", "VVG", "DBG", "MWSTG")
FAMILIES_RULE = (
    "ATSG", "BGG", "BV", "CPLR", "DBG", "IVG", "LAI", "MWSTG", "OR", "SCHKG", "STGB", "STPO", "SVG", "VVG", "ZGB", "ZPO",
)
FAMILIES_PARAGRAPH = ("ZGB", "OR", "BGG", "STPO", "BV", "IPRG", "ZPO", "STGB", "ATSG", "VVG", "SVG", "DBG", "MWSTG")
FAMILIES_ROUTE = ("ZGB", "OR", "BGG", "StPO", "BV", "IPRG", "IVG", "ATSG", "SVG", "ZPO", "StGB", "VVG", "DBG", "MWSTG")

FAMILY_TERMS = {
    "STPO": [
        "StPO", "Strafprozessordnung", "Strafverfahren", "Untersuchungshaft", "Haft", "Kollusionsgefahr",
        "Fluchtgefahr", "dringender Tatverdacht", "rechtliches Gehoer",
    ],
    "STGB": [
        "StGB", "Strafgesetzbuch", "ungetreue Geschaeftsbesorgung", "oeffentliche Interessen", "Anklage", "Schuld",
        "Strafe", "Taeterschaft",
    ],
    "ZGB": [
        "ZGB", "Zivilgesetzbuch", "Erbrecht", "Testament", "eigenhaendige letztwillige Verfuegung",
        "Urteilsfaehigkeit", "Kindesrecht", "Besuchsrecht", "persoenlicher Verkehr", "Kindeswohl", "Unterhalt",
    ],
    "OR": [
        "OR", "Obligationenrecht", "Auftrag", "Vertrag", "Haftung", "Sorgfaltspflicht", "Bank", "Ueberweisung",
        "grobe Fahrlaessigkeit", "Genehmigung", "Waehrung",
    ],
    "ZPO": ["ZPO", "Zivilprozessordnung", "Klage", "Beweis", "Zeugnis", "Verfahren", "Rechtsbegehren"],
    "SCHKG": ["SchKG", "Schuldbetreibung", "Konkurs", "Vollstreckung", "Sicherstellung", "Pfaendung"],
    "BV": ["BV", "Bundesverfassung", "rechtliches Gehoer", "Unschuldsvermutung"],
    "AIG": ["AIG", "Auslaender", "Migration", "Aufenthalt"],
    "BGG": ["BGG", "Bundesgerichtsgesetz", "Beschwerde", "Frist"],
    "IPRG": ["IPRG", "internationales Privatrecht", "anwendbares Recht"],
    "ATSG": ["ATSG", "Sozialversicherung", "Arbeitsunfaehigkeit", "Invaliditaet"],
    "IVG": ["IVG", "Invalidenversicherung", "Eingliederung", "Erwerbsunfaehigkeit"],
}

#: family -> cue and its weight; a weight of 0 never counts
FAMILY_CUES = {
    "STPO": [
        ("stpo", 8), ("pretrial detention", 5), ("pre-trial detention", 5), ("detention", 3), ("collusion", 4),
        ("flight risk", 4), ("sufficient suspicion", 4), ("coercive measures", 4), ("right to be heard", 2),
        ("presumption of innocence", 2),
    ],
    "STGB": [
        ("stgb", 8), ("disloyal management", 6), ("public interests", 3), ("criminal proceedings", 4),
        ("indictment", 4), ("conviction", 3), ("offenses", 2), ("theft", 2), ("assault", 2),
    ],
    "ZGB": [
        ("zgb", 8), ("civil code", 6), ("will", 3), ("testament", 5), ("testator", 5), ("estate", 4), ("heir", 4),
        ("holographic", 4), ("custody", 4), ("visitation", 5), ("overnight", 3), ("child support", 5),
        ("maintenance", 4), ("co-parent", 3), ("children", 3), ("best interests", 4),
    ],
    "OR": [
        ("or", 0), ("code of obligations", 7), ("contract", 4), ("liability", 5), ("damages", 4), ("bank", 2),
        ("account holder", 4), ("duty of care", 5), ("gross negligence", 5), ("exculpatory", 4), ("forged", 3),
        ("transfer instructions", 4), ("currency", 3),
    ],
    "ZPO": [
        ("zpo", 8), ("civil procedure", 6), ("civil judge", 3), ("pleaded", 3), ("testimony", 3), ("admissible", 3),
        ("claim", 2), ("proceedings", 1),
    ],
    "SCHKG": [("schkg", 8), ("enforcement", 3), ("forced sale", 4), ("freeze", 3), ("security", 2)],
    "BV": [("bv", 8), ("constitutional", 4), ("right to be heard", 4), ("presumption of innocence", 4)],
    "AIG": [("aig", 8), ("foreign national", 4), ("asylum", 4), ("residence permit", 4), ("deportation", 4)],
}

#: family -> rules in order, each with its name, its cues and its terms
ISSUE_RULES = {
    "STPO": [
        (
            "pretrial_detention",
            ["pretrial detention", "pre-trial detention", "detention", "coercive measures"],
            ["Untersuchungshaft", "Sicherheitshaft", "dringend verdaechtig", "dringend verdächtig"],
        ),
        (
            "collusion_flight_risk",
            ["collusion", "flight risk", "tamper", "witness"],
            ["Kollusionsgefahr", "Fluchtgefahr", "Personen beeinflusst", "Beweismittel einwirkt"],
        ),
        (
            "appeal_costs_criminal_procedure",
            ["appeal", "complaint", "costs", "extension"],
            ["Beschwerde", "Beschwerdelegitimation", "Frist", "Verfahrenskosten"],
        ),
        (
            "indictment_principle",
            ["indictment", "remand", "sentencing", "conviction"],
            ["Anklagegrundsatz", "Anklageschrift", "Umgrenzungsfunktion", "Rueckweisung", "Rückweisung"],
        ),
    ],
    "BV": [
        (
            "right_to_be_heard",
            ["right to be heard", "heard", "reasoning", "breach"],
            ["rechtliches Gehoer", "rechtliches Gehör", "Begruendungspflicht", "Begründungspflicht"],
        ),
        (
            "presumption_of_innocence",
            ["presumption of innocence", "sufficient suspicion", "suspicion"],
            ["Unschuldsvermutung", "Grundrechte"],
        ),
    ],
    "ZGB": [
        (
            "holographic_will_form",
            ["handwritten will", "holographic", "formal requirements", "third party", "will meet the formal"],
            [
                "eigenhaendige Verfuegung", "eigenhändige Verfügung", "letztwillige Verfuegung",
                "letztwillige Verfügung", "Erblasser",
            ],
        ),
        (
            "testamentary_capacity",
            ["testamentary capacity", "testator", "language comprehension", "annul", "validity"],
            [
                "Urteilsfaehigkeit", "Urteilsfähigkeit", "Testierfaehigkeit", "Testierfähigkeit", "Ungueltigkeit",
                "Ungültigkeit",
            ],
        ),
        (
            "custody_visitation",
            ["custody", "visitation", "overnight", "contact", "family welfare"],
            ["elterliche Sorge", "Obhut", "persoenlicher Verkehr", "persönlicher Verkehr", "Betreuungsanteile"],
        ),
        (
            "child_best_interests_support",
            ["child support", "best interests", "children", "maintenance", "support was fixed"],
            ["Kindeswohl", "Unterhaltsbeitrag", "Kindesunterhalt", "Unterhaltspflicht"],
        ),
        (
            "maintenance_security_enforcement",
            ["future maintenance", "security", "freeze", "forced sale", "enforcement authority", "sale proceeds"],
            [
                "Sicherstellung", "kuenftige Unterhaltsbeitraege", "künftige Unterhaltsbeiträge",
                "Vermoegen beiseite schaffen", "Vermögen beiseite schaffen", "Unterhaltspflicht", "Kindesschutz",
            ],
        ),
        (
            "ownership_good_faith_possession",
            ["donated", "deed of gift", "physical delivery", "good faith", "ownership", "possessor"],
            ["Eigentum", "Besitz", "guter Glaube", "Herausgabe", "Schenkung"],
        ),
    ],
    "OR": [
        (
            "contract_work_liability",
            ["contract for work", "gratuitous", "standard of care", "liable", "damage"],
            ["Werkvertrag", "Auftrag", "Sorgfaltspflicht", "Haftung", "Schadenersatz"],
        ),
        (
            "bank_forged_payment_orders",
            ["bank", "forged", "transfer instructions", "signature", "statement-hold", "written protest"],
            [
                "Bankvertrag", "Auftrag", "Vorschrift", "Beauftragte", "Auftraggeber", "Zahlungsauftrag",
                "Ueberweisung", "Überweisung", "Unterschrift", "Genehmigung",
            ],
        ),
        (
            "gross_negligence_exculpation_currency",
            ["gross negligence", "exculpatory", "risk-allocation", "currency", "indemnification"],
            [
                "grobe Fahrlaessigkeit", "grobe Fahrlässigkeit", "Wegbedingung der Haftung", "Geldschulden",
                "Waehrung", "Währung", "Landeswaehrung", "Landeswährung", "Fremdwaehrung", "Fremdwährung",
            ],
        ),
    ],
    "STGB": [
        (
            "disloyal_public_management",
            ["disloyal management", "public interests", "town council", "municipal", "publicly funded"],
            [
                "Ungetreue Amtsfuehrung", "Ungetreue Amtsführung", "oeffentliche Interessen",
                "öffentliche Interessen", "Beamte",
            ],
        ),
        (
            "criminal_liability_sentence",
            ["conviction", "offense", "offences", "sentence", "sentencing"],
            ["Vorteil", "Freiheitsstrafe", "Geldstrafe", "Schuld"],
        ),
    ],
    "ZPO": [
        (
            "civil_procedure_evidence_transition",
            ["testimony", "pleaded", "admissible", "civil procedure", "first challenged", "protest"],
            ["Zivilprozessordnung", "Beweis", "Zeugnis", "Rechtsbegehren"],
        ),
    ],
    "SCHKG": [
        (
            "debt_enforcement_security",
            ["debt enforcement", "debt collection", "bankruptcy", "debt enforcement office"],
            ["Sicherstellung", "Vollstreckung", "Verwertung", "Betreibung"],
        ),
    ],
}

# ---- fixed values: query views ---------------------------------------------------------------------------------------
LEGAL_PHRASES = (
    "provisional measures", "pre trial detention", "risk of collusion", "burden of proof", "statute of limitations",
    "unfair competition", "trade secret", "copyright infringement", "gross negligence", "proportionality",
)
STOPWORDS = [
    "the", "a", "an", "and", "or", "to", "of", "for", "in", "on", "with", "under", "by", "is", "are", "was", "were",
    "be", "been", "that", "this", "it", "as", "at", "from", "into", "does", "do", "did", "have", "has", "had", "may",
    "can", "should",
]

GENERAL_EN_DE = {
    "contract": ["vertrag", "vertragsrecht"],
    "liability": ["haftung"],
    "damages": ["schadenersatz", "schaden"],
    "employment": ["arbeitsrecht", "arbeitsverhaeltnis"],
    "tax": ["steuer", "steuerrecht"],
    "criminal": ["strafrecht", "strafbar"],
    "procedure": ["verfahren", "prozessrecht"],
    "appeal": ["berufung", "beschwerde"],
    "inheritance": ["erbrecht", "nachlass"],
    "property": ["sachenrecht", "eigentum"],
    "company": ["gesellschaftsrecht", "unternehmen"],
    "insurance": ["versicherung", "versicherungsrecht"],
    "evidence": ["beweis", "beweiswuerdigung"],
    "jurisdiction": ["zustaendigkeit", "gerichtsbarkeit"],
    "article": ["artikel", "art."],
    "section": ["abschnitt", "sektion"],
    "paragraph": ["absatz", "para", "paragraph"],
    "court": ["gericht", "bundesgericht"],
}
LAWS_EN_DE = {
    "article": ["artikel", "art."],
    "paragraph": ["absatz", "para", "paragraph"],
    "section": ["abschnitt", "sektion"],
    "act": ["gesetz", "erlass"],
    "code": ["kodex", "gesetzbuch"],
    "ordinance": ["verordnung"],
    "tax": ["steuer", "steuerrecht"],
    "criminal": ["strafrecht", "strafbar"],
    "civil": ["zivilrecht"],
    "employment": ["arbeitsrecht", "arbeitsverhaeltnis"],
    "insurance": ["versicherung", "versicherungsrecht"],
    "company": ["gesellschaftsrecht", "unternehmen"],
    "inheritance": ["erbrecht", "nachlass"],
    "property": ["sachenrecht", "eigentum"],
    "jurisdiction": ["zustaendigkeit", "gerichtsbarkeit"],
}
COURT_EN_DE = {
    "appeal": ["berufung", "beschwerde"],
    "evidence": ["beweis", "beweiswuerdigung"],
    "procedure": ["verfahren", "prozessrecht"],
    "burden of proof": ["beweislast"],
    "damages": ["schadenersatz", "schaden"],
    "negligence": ["fahrlassigkeit", "sorgfaltspflichtverletzung"],
    "liability": ["haftung"],
    "termination": ["kuendigung", "beendigung"],
    "invalidity": ["ungueltigkeit", "nichtigkeit"],
    "abuse": ["missbrauch", "rechtsmissbrauch"],
    "compensation": ["entschaedigung", "ausgleich"],
    "contract dispute": ["vertragsstreit", "vertragskonflikt"],
}
STATUTE_STYLE_EN_DE = {
    "article": ["artikel", "art."],
    "paragraph": ["absatz", "paragraph", "para"],
    "section": ["abschnitt", "sektion"],
    "chapter": ["kapitel"],
    "code": ["gesetzbuch", "kodex"],
    "act": ["gesetz", "erlass"],
    "ordinance": ["verordnung"],
    "regulation": ["regelung", "vorschrift"],
    "obligation": ["pflicht", "verpflichtung"],
    "requirement": ["voraussetzung", "anforderung"],
    "prohibition": ["verbot", "unzulaessigkeit"],
    "exception": ["ausnahme"],
    "validity": ["gueltigkeit", "wirksamkeit"],
    "termination": ["beendigung", "kuendigung"],
    "liability": ["haftung"],
    "compensation": ["entschaedigung", "ausgleich"],
    "employment law": ["arbeitsrecht"],
    "tax law": ["steuerrecht"],
    "criminal law": ["strafrecht"],
    "civil law": ["zivilrecht"],
    "insurance law": ["versicherungsrecht"],
    "company law": ["gesellschaftsrecht"],
    "inheritance law": ["erbrecht"],
    "property law": ["sachenrecht"],
}
GENERAL_SNIPPETS = ("anwendbares recht", "rechtliche wuerdigung", "zustaendiges gericht", "einschlaegige norm")
LAWS_SNIPPETS = ("einschlaegige gesetzesnorm", "anwendbarer artikel", "gesetzliche voraussetzungen")
STATUTE_STYLE_SNIPPETS = ("gesetzliche regelung und voraussetzungen", "anwendbare artikel und absaetze", "pflichten aus gesetz und verordnung", "ausnahmen und wirksamkeit der norm")
COURT_SNIPPETS = ("gerichtliche erwaegungen", "beweiswuerdigung und verfahren", "beschwerde und entscheidgruende")

# ---- fixed values: patterns ------------------------------------------------------------------------------------------
ARTICLE = r"(?i)\b(?:art\.?|article)\s*\d+[a-z]?(?:\s*abs\.?\s*\d+)?(?:\s*lit\.?\s*[a-z])?(?:\s+[A-Z][A-Za-z0-9]+)?"
SECTION = r"(?i)\bsection\s+\d+[a-z]?\b"
PARAGRAPH = r"(?i)\b(?:paragraph|para\.?|§)\s*\d+[a-z]?\b"
CASE = r"\b\d+[A-Z]_[0-9]+/[0-9]{4}\b"
JUDGMENT = r"(?i)\b\d+[A-Za-z]*_[0-9]+/[0-9]{4}\s*E\.\s*[0-9.]+\b"
REPORTER = r"(?i)\bBGE\s+\d+\s+[IVXLC]+\s+\d+(?:\s+E\.\s*[0-9.]+)?\b"
ARTICLE_SHORT = r"(?i)\bArt\.\s*\d+[a-z]?(?:\s*Abs\.\s*\d+)?(?:\s*lit\.\s*[a-z])?(?:\s+[A-Z][A-Za-z0-9]+)?"
NUMBERED_NAME = r"\b\d+[a-z]?(?:\.\d+)?\s+[A-Z][A-Za-z]{1,10}\b"
CASE_WITH_RECITAL = r"(?i)\b\d+[A-Za-z]*_[0-9]+/[0-9]{4}(?:\s*E\.\s*[0-9.]+)?\b"
NAMED_DECISION = r"(?i)\b(?:urteil|judgment|decision)\s*[0-9A-Za-z_./-]+\b"
#: All patterns that number a provision or a decision, and those that make a query explicit.
NUMBER_PATTERNS = (ARTICLE, SECTION, PARAGRAPH, CASE, JUDGMENT, REPORTER, ARTICLE_SHORT, NUMBERED_NAME)
RULE_PATTERNS = (ARTICLE, REPORTER, CASE_WITH_RECITAL, NAMED_DECISION)
CASE_SIGNALS = {
    "case_number": CASE,
    "common_case_prefix": r"(?i)\b(?:1B|6B|8C|5A|4A)_[0-9]+/[0-9]{4}\b",
    "bge": r"(?i)\bBGE\s+\d+\s+[IVXLC]+\s+\d+\b",
    "judgment_paragraph": r"(?i)\bE\.\s*\d+(?:\.\d+)*\b",
}
STATUTE_SIGNALS = {
    "art": r"(?i)\bArt\.?\s*\d+[a-z]?\b",
    "article": r"(?i)\barticle\s+\d+[a-z]?\b",
    "abs": r"(?i)\bAbs\.?\s*\d+[a-z]?\b",
    "lit": r"(?i)\blit\.?\s*[a-z]\b",
    "statute_family": r"(?i)\b(?:" + "|".join(FAMILIES_ROUTE) + r")\b",
}

# Names of codes in English, what a gold pattern looks like, the pattern and numbers of the plain extraction, and
# the marks of a question that names a source.
CODE_NAMES = (
    ("ZGB", r"(?i)\bcivil code\b"),
    ("OR", r"(?i)\bcode of obligations\b"),
    ("STPO", r"(?i)\bcriminal procedure code\b"),
    ("STGB", r"(?i)\bcriminal code\b"),
    ("ZPO", r"(?i)\bcivil procedure\b"),
)
GOLD_PATTERN = r"(?i)(art\.|article|bge|\d+[A-Za-z]*_[0-9]+/[0-9]{4})"
PLAIN_ARTICLE = r"Art\.\s*\d+(?:\s+(?:Abs\.|lit\.|Ziff\.)\s+[a-z0-9]+)*\s+[A-Za-z]+"
SR_NUMBERS = {"StPO": "312.0", "StGB": "311.0", "ZGB": "210", "OR": "220", "BGG": "173.110", "BV": "101"}
ANCHORS = ("Art.", "BGE", "_")
