"""Fixed values of the routing policy, scoring and evidence rules."""

# Routes in order of preference among equals.
ROUTES = ("R0", "R1", "R2", "R3", "R4")
# Price of latency (a second), cost (a cent) and risk.
LAMBDA_LATENCY, LAMBDA_COST, LAMBDA_RISK = 0.09, 0.12, 0.55
# Route, base latency, latency per candidate, input tokens, output tokens, base risk, freshness and conflict penalties, prior.
ROUTE_TABLE = (
    ("R0", 0.05, 0.0, 250, 120, 0.02, 0.0, 0.0, 0.30),
    ("R1", 0.12, 0.002, 1400, 260, 0.20, 0.16, 0.14, 0.30),
    ("R2", 0.22, 0.003, 1500, 260, 0.20, 0.16, 0.14, 0.32),
    ("R3", 0.34, 0.004, 2000, 300, 0.12, 0.05, 0.02, 0.42),
    ("R4", 0.45, 0.005, 2400, 320, 0.10, 0.02, 0.0, 0.40),
)
# Route, feature, weight of the expected evidence quality.
QUALITY_WEIGHTS = (
    ("R0", "unsupported_signal", 0.55), ("R0", "followup_signal", 0.10), ("R0", "semantic_ambiguity", 0.12), ("R0", "sparse_confidence", -0.35), ("R0", "dense_confidence", -0.35),
    ("R1", "identifier_signal", 0.34), ("R1", "lexical_specificity", 0.20), ("R1", "intent_lookup", 0.10), ("R1", "numeric_signal", 0.06), ("R1", "semantic_ambiguity", -0.22), ("R1", "hop_signal", -0.20), ("R1", "comparison_signal", -0.18), ("R1", "sparse_confidence", 0.42),
    ("R2", "semantic_ambiguity", 0.20), ("R2", "intent_explanation", 0.14), ("R2", "intent_summarisation", 0.10), ("R2", "identifier_signal", -0.30), ("R2", "lexical_specificity", -0.12), ("R2", "hop_signal", -0.18), ("R2", "comparison_signal", -0.16), ("R2", "dense_confidence", 0.44),
    ("R3", "identifier_signal", 0.10), ("R3", "semantic_ambiguity", 0.12), ("R3", "intent_explanation", 0.08), ("R3", "intent_procedural", 0.10), ("R3", "mixed_signal", 0.16), ("R3", "hop_signal", -0.08), ("R3", "sparse_confidence", 0.20), ("R3", "dense_confidence", 0.20),
    ("R4", "hop_signal", 0.26), ("R4", "comparison_signal", 0.24), ("R4", "temporal_signal", 0.12), ("R4", "intent_comparison", 0.10), ("R4", "query_length", 0.06), ("R4", "identifier_signal", -0.04), ("R4", "sparse_confidence", 0.12), ("R4", "dense_confidence", 0.12),
)
# Weights of scope and probe in the risk; depths; prices; thresholds of the evidence gate.
RESTRICTED_WEIGHT, LOW_PROBE_WEIGHT, LOW_PROBE_REFERENCE, MIN_PROBE = 0.30, 0.45, 0.65, 0.12
PROBE_K, CANDIDATE_K, RRF_K, RERANK_K, EVIDENCE_K, SUBQUERIES, SUBQUERY_K = 5, 10, 60, 8, 5, 3, 5
USD_IN, USD_OUT = 3.0, 15.0
MIN_TOP, MIN_MEAN, MIN_CHUNKS, MIN_DOCS, MIN_AUTHORITY, STALE = 0.10, 0.09, 1, 2, 3, 0.55
# Query feature lexicons.
IDENTIFIERS = (r"\b[A-Z]{2,6}-\d{2,6}\b", r"\b[A-Z]{2,}\d{3,}\b", r"\berror\s+code\s+\S+", r"\bclause\s+\d+(\.\d+)*\b", r"\bsection\s+\d+(\.\d+)*\b", r"\bv\d+\.\d+(\.\d+)?\b", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b")
TEMPORAL = ("current", "latest", "now", "today", "effective", "2024", "2025", "2026", "updated", "new", "recent", "as of", "still", "changed", "change")
COMPARISON = ("compare", "comparison", "versus", "vs", "difference", "differ", "differences", "both", "between", "contrast", "changed from", "instead of")
MULTIHOP = ("and also", "then", "which", "who", "across", "each", "all projects", "every", "impact", "affect", "affects")
FOLLOWUP = ("it", "that", "this", "they", "those", "the same", "he", "she")
INTENTS = (
    ("lookup", ("what is", "what's", "define", "who is", "when is", "which", "list", "code", "how many", "how much")),
    ("explanation", ("why", "explain", "how does", "rationale", "reason", "purpose", "means")),
    ("comparison", ("compare", "versus", "vs", "difference", "differ", "contrast")),
    ("summarisation", ("summarise", "summarize", "summary", "overview", "status of", "brief")),
    ("procedural", ("how do i", "how to", "steps", "procedure", "process", "runbook", "resolve", "fix", "remediate")),
    ("temporal", ("current", "latest", "effective", "as of", "since", "changed", "updated", "new policy")),
)
DOC_TYPES = (
    ("policy", ("policy", "leave", "vacation", "pto", "hr", "entitlement", "compliance", "handbook")),
    ("runbook", ("error", "runbook", "incident", "alert", "service", "restart", "latency", "oncall", "on-call")),
    ("report", ("status", "milestone", "project", "quarter", "delivery", "roadmap", "budget burn")),
    ("finance", ("revenue", "margin", "forecast", "ebitda", "salary", "compensation", "budget", "financial")),
)
# What counts as a number, and as a date.
NUMERIC = r"\b\d+(?:[.,]\d+)?\b"
DATES = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|q[1-4]\s*\d{4}|\d{4})\b"
# Words that carry no signal in a query's features.
FEATURE_STOPWORDS = "a an and are as at be been being but by can could do does did for from had has have how i if in into is it its me my of on or our should so than that the their them then there these they this those to under was we were what when where which who whom why will with would you your about above after again all am any because before below between both during each few further here him his more most no nor not now once only other out over own same some such through too very while".split()
# Words that the reranker leaves out.
RERANK_STOPWORDS = "a an and are as at be by for from has have how in is it its of on or that the to was were what when where which who why will with would you your do does i my we our".split()
# What a quantity is about.
TOPICS = ("leave", "annual leave", "carry over", "carry-over", "carried over", "entitlement", "accrue", "notice", "approval", "respond", "abroad", "attendance", "on site", "deadline", "submitted", "timeout", "allowance")
# First words that point at the turn before.
LEADING_PRONOUNS = ("it", "that", "this", "they", "those", "these", "he", "she", "and", "what")
# How queries are split: openers of two words and of one, words that a topic loses at its end and anywhere, signs of change, connectives.
OPENERS_TWO = ("what is", "what are", "tell me", "can you", "could you")
OPENERS_ONE = ("what's", "what", "how", "why", "when", "which", "who", "explain", "describe", "please")
TOPIC_ENDS = ("the", "a", "an", "is", "are", "was", "were", "do", "does", "did", "between", "of", "for", "in", "on")
CHANGE_WORDS = ("difference", "differences", "differ", "change", "changed", "compare", "comparison", "contrast")
ARTICLES = ("the", "a", "an")
VERSUS = r"(?i)\s+(?:versus|vs\.?|compared to|compared with|against|and how does)\s+"
JOINED = r"(?i)\s*(?:;|\?|\band also\b|\band then\b|\bas well as\b)\s*"
BETWEEN = r"(?is)\bbetween\s+(.+?)\s+and\s+(.+?)(?:\?|$)"
# Tokens of search and of query features, headings, units of quantities, citations.
TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
WORD = r"[A-Za-z0-9][A-Za-z0-9\-_.']*"
HEADING = r"^\s*(?:#{1,6}\s+\S.*|\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]{0,58}|[A-Z][A-Z \-/&]{6,58})\s*$"
UNITS = r"days?|working days?|calendar days?|weeks?|months?|years?|hours?|percent|%|per cent|basis points?|miles?|nights?"
CITATION = r"\[([A-Za-z0-9][A-Za-z0-9\-_.]*::c\d+)\]"
