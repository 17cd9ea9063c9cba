"""Fixed values that results depend on: type groups, thresholds, word lists, rules."""

TYPE_GROUPS = {
    "PARTY": ["INDIVIDUAL", "CORPORATION", "ORGANIZATION", "GOVERNMENT"],
    "COURT": ["SUPREME_COURT", "APPELLATE_COURT", "DISTRICT_COURT", "STATE_COURT"],
    "JUDGE": ["CHIEF_JUSTICE", "ASSOCIATE_JUSTICE", "MAGISTRATE"],
    "ATTORNEY": ["PROSECUTOR", "DEFENSE_ATTORNEY", "COUNSEL"],
    "CITATION": ["CASE_CITATION", "STATUTE_CITATION", "REGULATION_CITATION"],
}
THRESHOLDS = {"PARTY": 0.85, "COURT": 0.90, "JUDGE": 0.88, "ATTORNEY": 0.85, "CITATION": 0.95, "STATUTE": 0.92}
DEFAULT_THRESHOLD = 0.85
BOOSTED_TYPES = ["PARTY", "COURT", "JUDGE", "ATTORNEY"]

KEYWORDS = [
    ("REPRESENTS", ["attorney", "counsel", "lawyer", "represents", "on behalf of"]),
    ("EMPLOYS", ["employee", "works for", "employed by", "staff"]),
    ("OWNS", ["owner", "owns", "proprietor", "subsidiary"]),
    ("CITES", ["cites", "references", "pursuant to", "under", "according to"]),
    ("OVERRULES", ["overrules", "overturns", "reverses", "vacates"]),
    ("FOLLOWS", ["follows", "adheres to", "consistent with", "in accordance with"]),
    ("OPPOSES", ["versus", "v.", "against", "plaintiff", "defendant", "appellant", "appellee"]),
    ("GOVERNS", ["governs", "regulates", "oversees", "jurisdiction over"]),
    ("AFFILIATES", ["affiliated with", "associated with", "member of", "part of"]),
]
TYPE_RULES = [
    ("ATTORNEY", "PARTY", "REPRESENTS"),
    ("PARTY", "PARTY", "OPPOSES"),
    ("COURT", "CASE", "PRESIDES"),
    ("JUDGE", "COURT", "SERVES_ON"),
    ("STATUTE", "REGULATION", "AUTHORIZES"),
    ("CASE", "CASE", "CITES"),
    ("CORPORATION", "INDIVIDUAL", "EMPLOYS"),
]
#: Relations that hold both ways.
UNDIRECTED = ["AFFILIATES", "ASSOCIATES"]

LEGAL_TYPES = ["PARTY", "COURT", "JUDGE", "ATTORNEY", "CASE", "STATUTE"]
TYPE_IMPORTANCE = {"COURT": 1.0, "JUDGE": 0.9, "PARTY": 0.8, "ATTORNEY": 0.7, "CASE": 0.9, "STATUTE": 0.85}

INTENTS = [
    ("case_specific", ["this case", "our case", "case number", "plaintiff", "defendant"]),
    ("precedent", ["precedent", "case law", "similar cases", "court held", "ruling"]),
    ("procedural", ["deadline", "filing", "procedure", "court rules", "when to"]),
    ("contextual", ["who", "what", "where", "when", "parties involved"]),
]

DESCRIPTIONS = {
    "COURT": "Judicial body", "JUDGE": "Judicial officer", "GOVERNMENT_ENTITY": "Government department or agency", "LAW_FIRM": "Legal practice organization", "ATTORNEY": "Legal counsel",
    "PLAINTIFF": "Party bringing legal action", "DEFENDANT": "Party defending legal action", "APPELLANT": "Party appealing decision", "APPELLEE": "Party responding to appeal",
    "CASE_CITATION": "Legal case reference", "STATUTE": "Legislative enactment", "STATUTE_CITATION": "Statutory reference", "REGULATION": "Administrative rule", "REGULATION_CITATION": "Regulatory reference",
    "FILING_DATE": "Document filing date", "DECISION_DATE": "Judicial decision date", "HEARING_DATE": "Court hearing date", "DEADLINE": "Legal deadline", "DATE": "Temporal reference",
    "MONETARY_AMOUNT": "Financial value", "CONTRACT": "Legal agreement", "MOTION": "Legal request to court", "BRIEF": "Legal argument document", "COMPLAINT": "Initial legal filing", "PARTY": "Litigation participant",
    "FEDERAL_AGENCY": "Federal government agency", "STATE_AGENCY": "State government agency", "JURISDICTION": "Legal authority area", "VENUE": "Legal proceeding location", "DISTRICT": "Judicial district",
    "CIRCUIT": "Appellate circuit", "SETTLEMENT": "Legal dispute resolution", "DAMAGES": "Legal compensation", "LEGAL_CONCEPT": "Legal principle or doctrine", "LEGAL_MARKER": "Legal indicator or reference",
    "PERSON": "Individual", "ORGANIZATION": "Legal entity or organization", "LOCATION": "Geographic location", "UNKNOWN": "Entity",
}
