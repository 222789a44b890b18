"""Small literal inputs for operators that the large tables don't exercise, with the
results that follow from the rules."""

#: query_id, question, search intent, answer intent
QUESTIONS = (
    (1, "What were net sales in 2019?", "numeric_table", "numeric_table"),
    (2, "Who is Dana Whitfield?", "entity_lookup", "entity_lookup"),
    (3, "Tell me more about risk factors", "section_overview", "section_overview"),
    (4, "Item 3", "section_overview", "section_overview"),
    (5, "Summarize item 1a themes", "narrative_explainer", "narrative_explainer"),
    (6, "What facilities does the company operate?", "narrative_explainer", "narrative_explainer"),
    (7, "We Face Intense Competition", "heading_lookup", "heading_lookup"),
    (8, "Where is my refund", "general_lookup", "general_lookup"),
    (9, "Explain liquidity", "narrative_explainer", "narrative_explainer"),
    (10, "How many employees work there?", "general_lookup", "numeric_table"),
    (11, "What is market risk", "narrative_explainer", "narrative_explainer"),
    (12, "Who are the directors?", "entity_lookup", "entity_lookup"),
    (13, "Loss of key personnel could harm our business", "heading_lookup", "heading_lookup"),
    (14, "selected consolidated financial data", "numeric_table", "numeric_table"),
    (15, "“Properties”?", "section_overview", "section_overview"),
)
#: query_id of QUESTIONS -> item of its overview, items expected of its answer
OVERVIEWS = {3: "Item 1A. Risk Factors", 4: "Item 3. Legal Proceedings", 15: "Item 2. Properties"}
EXPECTED = {
    3: ("Item 1A. Risk Factors",), 4: ("Item 3. Legal Proceedings",), 5: ("Item 1A. Risk Factors",), 6: ("Item 2. Properties",), 13: ("Item 1. Business",),
    11: ("Item 7A. Quantitative and Qualitative Disclosures About Market Risk",), 14: ("Item 2. Properties", "Item 8. Financial Statements and Supplementary Data"), 15: ("Item 2. Properties",),
}
#: query_id of QUESTIONS -> item that the question names
NAMED_ITEMS = {4: "Item 3. Legal Proceedings", 5: "Item 1A. Risk Factors"}
#: value, name valid, iso date, last four valid
IDENTITIES = (
    ("  Ada   Byron ", True, None, False), ("Ada", False, None, False), ("31-02-1990", False, None, False), ("09-11-1985", False, "1985-11-09", False),
    ("1985-11-09", False, None, False), (" 0420 ", False, None, True), ("12345", False, None, False), ("", False, None, False),
)
#: message, name, birth date, last four
MESSAGES = (
    ("my name is Ada Byron", "Ada Byron", None, None), ("born 09-11-1985", None, "09-11-1985", None), ("4321", None, None, "4321"),
    ("the last 4 are 9876", None, None, "9876"), ("track my order", "track my order", None, None), ("SSN: 1111 and 01-02-1999", None, "01-02-1999", "1111"),
)
#: session_id, turn, message, whole answer (null where no order was asked for)
_ASK = "I can help check your order status, but I need to verify your identity first."
_NAME, _DAY, _LAST4 = "Please share your full name.", "Please share your date of birth in DD-MM-YYYY format.", "Please share the last 4 digits of your SSN."
DIALOGUE = (
    ("s1", 1, "where is my order?", f"{_ASK} {_NAME}"), ("s1", 2, "my name is Ada Byron", f"{_ASK} {_DAY}"),
    ("s1", 3, "1985-11-09", f"Please provide your date of birth in DD-MM-YYYY format. {_DAY}"), ("s1", 4, "09-11-1985", f"{_ASK} {_LAST4}"),
    ("s1", 5, "4321", "Your order A-1 is currently in transit via Post. Estimated delivery is 2030-01-02."),
    ("s2", 1, "hello there", None), ("s2", 2, "shipment of Bo Li?", f"{_ASK} {_NAME}"), ("s2", 3, "i am Bo Li", f"{_ASK} {_DAY}"), ("s2", 4, "01-01-1970", f"{_ASK} {_LAST4}"),
    ("s2", 5, "0000", "I could not find a matching order with the verified details provided. Please confirm your full name, date of birth, and last 4 digits of your SSN."),
    ("s2", 6, "where is my order", f"{_ASK} {_DAY}"),
)
ORDERS = (("c1", "ada  byron", "1985-11-09", "4321", "A-1", "in transit", "Post", "2030-01-02"),)
#: what the store holds after DIALOGUE: session_id, turn, part, role, content, personal, tool result
_PERSONAL = {("s1", 2), ("s1", 3), ("s1", 4), ("s1", 5), ("s2", 3), ("s2", 4), ("s2", 5)}
_LOOKED_UP = {("s1", 5): "order_found", ("s2", 5): "order_not_found"}
MESSAGE_LOG = tuple((s, n, 0, "user", said, (s, n) in _PERSONAL, None) for s, n, said, _ in DIALOGUE) + tuple((s, n, 1, "assistant", a, False, _LOOKED_UP.get((s, n))) for s, n, _, a in DIALOGUE if a)
#: events logged in DIALOGUE: session_id, turn, place, type
_OPENS, _COLLECTS, _REFUSED, _ENDS = "intent_classified", "order_workflow_collecting", "verification_failed", "chat_orchestration_completed"
_BY_TURN = {
    ("s1", 1): (_OPENS, _COLLECTS, _REFUSED, _ENDS), ("s1", 2): (_COLLECTS, _REFUSED, _ENDS), ("s1", 3): (_COLLECTS, _REFUSED, _ENDS), ("s1", 4): (_COLLECTS, _REFUSED, _ENDS),
    ("s1", 5): (_COLLECTS, "order_workflow_succeeded", _ENDS), ("s2", 1): (_OPENS, "knowledge_query_completed", _ENDS), ("s2", 2): (_OPENS, _COLLECTS, _REFUSED, _ENDS),
    ("s2", 3): (_COLLECTS, _REFUSED, _ENDS), ("s2", 4): (_COLLECTS, _REFUSED, _ENDS), ("s2", 5): (_COLLECTS, "order_workflow_not_found", _ENDS), ("s2", 6): (_OPENS, _COLLECTS, _REFUSED, _ENDS),
}
LOG_EVENTS = tuple((s, n, at, kind) for (s, n), kinds in _BY_TURN.items() for at, kind in enumerate(kinds))
#: raw, number
NUMBERS = (("(1,234)", -1234.0), ("$5", 5.0), ("1,000.25", 1000.25), ("-", None), ("—", None), ("n/a", None), ("($7.5)", -7.5), ("", None))
#: key, state of the version, result at 2026-01-01T00:20:00
INGEST = (
    ("in/a.md", None, None, "processing"), ("in/b.pdf", "completed", "2026-01-01T00:00:00Z", "completed"), ("in/c.txt", "processing", "2026-01-01T00:10:00Z", "skipped"),
    ("in/d.docx", "processing", "2025-12-31T00:00:00Z", "processing"), ("in/e.md", "failed", "2026-01-01T00:19:00Z", "processing"), ("in/f.exe", None, None, "unsupported_type"), ("in/g.md", "processing", None, "processing"),
)
#: page_no, lines of one filing
PAGES = (
    (1, ("ACME ANNUAL REPORT FORM 10-K", "For the fiscal year ended December 31, 2019", "Executive Officers and Directors", "Dana Whitfield 51 Chief Executive Officer", "Lee Park 47 Treasurer", "Dana Whitfield. Has led the firm since 2001.", "Board of Directors")),
    (2, ("PART I", "Item 1. Business", "General", "We serve consumers through stores and focus on selection for all of them.", "Consumers", "We design our stores to be found.")),
    (3, ("Item 1A. Risk Factors", "We Face Intense Competition", "Our rivals are many and strong.", "Loss of the Key People Could Harm Our Business We depend on few people.")),
    (4, ("Item 2. Properties", "We lease office space and operate fulfillment centers in many places.")),
    (5, ("PART II", "Item 6. Selected Consolidated Financial Data", "(in millions)", "2015 2016 2017 2018 2019", "Net sales $10 $20 $30 $40 $50", "Operating income 1 (2) 3 4 5")),
    (6, ("Item 8. Financial Statements and Supplementary Data", "Consolidated Statements of Operations", "2017 2018 2019", "Cost of goods 7 8 9")),
    (7, ("INDEX", "Item 1. Business 3", "Item 2. Properties 9")),
)
