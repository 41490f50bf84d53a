"""Word lists and patterns of the domain. All are defaults of parameters."""

# Section names that make a text a major heading, phrases that do so anywhere, and first words of headings.
MAJOR_SECTIONS = [
    "PROSPECTUS SUMMARY", "RISK FACTORS", "SPECIAL NOTE REGARDING FORWARD-LOOKING STATEMENTS", "INDUSTRY AND MARKET DATA",
    "USE OF PROCEEDS", "DIVIDEND POLICY", "CAPITALIZATION", "DILUTION", "MANAGEMENT'S DISCUSSION AND ANALYSIS", "BUSINESS",
    "MANAGEMENT", "EXECUTIVE COMPENSATION", "CERTAIN RELATIONSHIPS AND RELATED PARTY TRANSACTIONS",
    "PRINCIPAL AND SELLING STOCKHOLDERS", "DESCRIPTION OF CAPITAL STOCK", "SHARES ELIGIBLE FOR FUTURE SALE",
    "MATERIAL U.S. FEDERAL INCOME TAX CONSEQUENCES", "UNDERWRITERS", "LEGAL MATTERS", "EXPERTS",
    "WHERE YOU CAN FIND ADDITIONAL INFORMATION", "INDEX TO CONSOLIDATED FINANCIAL STATEMENTS",
]
MAJOR_PHRASES = ["MANAGEMENT'S DISCUSSION AND ANALYSIS", "FINANCIAL STATEMENTS", "RESULTS OF OPERATIONS", "LIQUIDITY AND CAPITAL RESOURCES", "CONSOLIDATED STATEMENTS"]
HEADING_WORDS = ["REVENUE", "INCOME", "EARNINGS", "FINANCIAL", "RESULTS", "OPERATIONS", "LIQUIDITY", "CAPITAL", "OWNERSHIP", "STOCKHOLDERS"]

# Synonyms of query words, phrases of documents by category, and the words that a synonym replaces.
SYNONYMS = {
    "revenue": ["income", "sales", "earnings", "turnover", "receipts", "proceeds"],
    "profit": ["earnings", "income", "gain", "surplus", "net income", "bottom line"],
    "growth": ["increase", "expansion", "rise", "improvement", "gain", "year-over-year", "yoy"],
    "ownership": ["shares", "equity", "stake", "holdings", "stock", "percentage"],
    "expenses": ["costs", "expenditures", "spending", "outlays", "charges"],
    "margin": ["profit margin", "gross margin", "operating margin", "markup"],
    "assets": ["resources", "holdings", "property", "capital"],
    "liabilities": ["debt", "obligations", "payables", "amounts owed"],
    "cash": ["cash flow", "liquidity", "funds", "money", "capital"],
    "risk": ["risks", "risk factors", "threats", "challenges", "uncertainties"],
}
DOCUMENT_PATTERNS = {
    "revenue": ["Our revenue was", "revenue for the year ended", "total revenue", "revenue increased", "revenue decreased", "revenue of $"],
    "growth": ["year-over-year growth", "growth rate", "representing % growth", "increased by %", "grew by %"],
    "ownership": ["owns shares", "ownership percentage", "voting power", "beneficial ownership", "shares outstanding"],
    "financial": ["for the year ended December 31", "for the three months ended", "fiscal year", "financial results", "financial performance"],
}
INTENT_PATTERNS = [(["revenue", "income"], ["$[0-9]+ million", "$[0-9]+.[0-9]+ million"]), (["growth", "increase"], ["[0-9]+% growth", "[0-9]+% year-over-year"])]
REPLACED_WORDS = ["revenue", "income", "earnings", "profit", "growth", "ownership"]
QUESTION_WORDS = ["What is", "What was", "How much", "?"]
#: Fixed values, in their own order: what questions are prefixed with.
CONTEXT_PREFIXES = ["In the S-1 filing,", "According to the S-1 document,", "The S-1 registration statement shows"]
#: Fixed values, in their own order: words of a question and the passage that is made up for it.
HYPOTHETICAL = [
    (["revenue", "income"], "Our revenue was $XXX million for the year ended December 31, 2024, representing XX% year-over-year growth compared to the year ended December 31, 2023."),
    (["growth"], "We achieved a year-over-year growth rate of XX%, with revenue increasing from $XXX million to $XXX million."),
    (["ownership"], "The beneficial ownership includes XX% of outstanding shares, representing XX% of total voting power."),
    ([], "According to our financial results, we reported $XXX million in the relevant period."),
]
#: Fixed values, in their own order: routes and the words that lead to them.
ROUTES = [
    ("ownership", ["ownership", "shares", "equity", "voting"]),
    ("financial", ["revenue", "income", "financial", "earnings", "loss"]),
    ("risk", ["risk", "factor", "threat", "challenge"]),
    ("business", ["business", "operations", "model", "strategy"]),
]

# Term lists of reranking, with the sections they favour and the factors. Names of a company's people are
# not among them: `with_names` adds them to the last list.
RERANK = [
    (["revenue", "income", "earnings", "profit", "loss", "ebitda", "margin", "growth", "sales", "costs", "expenses", "operating", "gross", "net", "financial", "statement", "quarter", "annual", "year-over-year", "yoy"],
     ["management's discussion", "financial", "results of operations", "consolidated statements"], 2.0),
    (["ownership", "shares", "equity", "stock", "voting", "stockholder", "shareholder", "percentage", "control", "class", "common", "preferred"],
     ["principal", "stockholder", "ownership", "capitalization", "dilution"], 2.0),
    (["ceo", "executive", "officer", "director", "management", "compensation", "salary", "bonus", "equity", "grant"],
     ["management", "executive", "compensation"], 1.8),
]


def with_names(names: list[str], lists: list[tuple[list[str], list[str], float]] = RERANK) -> list[tuple[list[str], list[str], float]]:
    """The lists of reranking with names of people, in lower case, before the words of their offices."""
    *rest, (words, sections, factor) = lists
    return [*rest, ([*names, *words], sections, factor)]


#: Fixed values: (query words, words that the text needs all of, sections one of which is needed) of the boost after hybrid search.
BOOSTS = [(["revenue", "income"], ["$", "million"], ["financial", "results"]), (["ownership"], ["%", "shares"], ["stockholder", "ownership"])]

# Descriptions of tables by words of the file name, then of the section.
TABLE_DESCRIPTIONS = [
    (["revenue", "income", "financial"], "Financial performance data including revenue, income, and operating metrics"),
    (["ownership", "stockholder", "equity"], "Ownership structure and stockholder information"),
    (["capitalization"], "Capitalization table showing share structure and ownership percentages"),
    (["dilution"], "Share dilution analysis for IPO investors"),
    (["compensation", "executive"], "Executive compensation and equity awards information"),
]
SECTION_DESCRIPTIONS = [("financial", "Financial data table"), ("management", "Management discussion and analysis supporting data")]
PRIORITY_KEYWORDS = ["revenue", "income", "profit", "expense", "operations"]

# Signs of placeholder text, and patterns of figures.
# digits are written [0-9], since PLACEHOLDER also runs in Python, where \d matches those of other scripts
PLACEHOLDER = r"(?i:from agent|agent analysis|placeholder|todo|tbd)|\[.*\]|^Driver [0-9]+$|^Risk [0-9]+$"
FINANCIAL_FIELDS = {
    "revenue": r"(?i)(?:revenue|sales).*?\$?([\d,]+\.?\d*)\s*(?:million|billion|M|B)",
    "growth_rate": r"(?i)(?:growth|grew|increased).*?([\d.]+)%",
    "gross_margin": r"(?i)gross margin.*?([\d.]+)%",
    "operating_margin": r"(?i)operating margin.*?([\d.]+)%",
    "cash_position": r"(?i)cash.*?\$?([\d,]+\.?\d*)\s*(?:million|billion|M|B)",
}
SCENARIOS = [
    ("base_case", "Moderate growth with balanced risk realization", "60%", ["Current market conditions persist", "Management executes on strategy"]),
    ("bull_case", "Strong growth with favorable market conditions", "20%", ["Market expansion", "Successful product launches"]),
    ("bear_case", "Challenging environment with multiple risk factors", "20%", ["Economic downturn", "Increased competition"]),
]
