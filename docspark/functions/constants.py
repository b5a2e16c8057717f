"""Values that have to be equal for results to be equal."""

# --- Fixed values: limits -------------------------------------------------
MAX_UPLOAD_BYTES = 120 * 1024 * 1024
MAX_CHUNKS_PER_DOC = 2000
ALLOWED_EXTENSIONS = [".pdf", ".docx", ".txt", ".md", ".json"]
TEXT_EXTENSIONS = [".txt", ".md", ".json", ".csv"]

# --- Fixed values: chunking and paging ------------------------------------
CHUNK_SIZE = 900
OVERLAP_SENTENCES = 2
GIANT_FACTOR = 1.5
GIANT_OVERLAP = 100
MIN_CHUNK_CHARS = 20
ROWS_PER_CHUNK = 15
OVERLAP_ROWS = 2
PAGE_CHARS = 2000
PAGE_WORDS = 300

# --- Fixed values: retrieval ----------------------------------------------
RRF_K = 60
RRF_KW_WEIGHT = 2.0
RRF_SEM_WEIGHT = 1.0
KEYWORD_TOP = 50
SEMANTIC_TOP = 100
RERANK_MOST = 30
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# --- Fixed values: classification -----------------------------------------
MULTI_LABEL_THRESHOLD = 0.4
SINGLE_LABEL_THRESHOLD = 0.35
MAX_TAGS_PER_VALUE = 20

# --- Fixed values: how much of a text the model-backed steps may be shown.
# Every function reads the whole text unless one of these is passed to it.
SHORT_SUMMARY_HEAD = 600

# --- Fixed values: tag vocabulary -----------------------------------------
SYLLABUS_TAGS = ["Course Syllabus", "Syllabus"]
NOTES_TAGS = ["Lecture Notes", "Lab Report", "Lab Notes"]
ASSIGN_TAGS = [
    "Assignment", "Final Exam", "Midterm Exam", "Exam / Quiz",
    "Question Bank", "Homework", "Project",
]
LEVEL_WORDS = [
    "Graduate", "Doctoral", "Undergraduate", "Upper", "Sophomore",
    "Introductory", "Advanced",
]
TERM_PATTERN = r"(?i)^(Spring|Fall|Summer|Winter)\s+\d{4}$"
PLACEHOLDER_TAGS = ["Uncategorized", "General"]
GENERIC_TAGS = ["uncategorized", "general", "document"]
FIXED_LABELS = [
    "Course Syllabus", "Syllabus", "Lecture Notes", "Lab Report", "Lab Notes",
    "Assignment", "Homework", "Final Exam", "Midterm Exam", "Exam / Quiz",
    "Report", "Question Bank", "Graduate Level", "Undergraduate Level", "Doctoral Level",
    "Writing-Intensive", "Discussion-Based", "Has Prerequisites",
    "Academic Document", "Document", "General", "Science", "Research",
]

# --- Fixed values: sentence signals ---------------------------------------
FINDING_SIGNAL = (
    r"\b(required|must|deadline|due|grading|policy|percent|%|credit|prerequisite"
    r"|attendance|submission|penalty|weight|points|late|exam|final|objective"
    r"|will be|students (must|are required|should))\b"
)
#: First characters of the signals above, in all that are the same in another case: elsewhere no word boundary is looked for.
FINDING_STARTS = "rRmMdDgGpP%cCaAwWsS\u017flLeEfFoO"
SCIENTIFIC_SIGNAL = (
    r"\b(found|show(ed|s)?|demonstrat(ed|es)?|conclud(ed|es)?|result(s|ed)?|"
    r"suggest(s|ed)?|indicat(ed|es)?|reveal(ed|s)?|associat(ed|es)?|"
    r"signific(ant|antly)|evidence|effect|increas(ed|es)?|decreas(ed|es)?|"
    r"higher|lower|greater|reduc(ed|es)?|improv(ed|es)?|inhibit(ed|s)?|"
    r"activat(ed|es)?|promot(ed|es)?|suppress(ed|es)?|correlat(ed|es)?|"
    r"compared|analysis|measur(ed|es)?|observ(ed|es)?)\b"
)
POLICY_SIGNAL = (
    r"\b(required|must|deadline|objective|goal|purpose|key|important|"
    r"critical|essential|primary|main|focus)\b"
)
OVERVIEW_PATTERN = (
    r"(?is)(?:course\s+(?:overview|description|summary|introduction)|about\s+this\s+course)"
    r"[:\s\n]+(.{40,350}?)(?:\n\n|\.\s+[A-Z]|goals|objectives|topics|materials|\z)"
)

# --- Fixed values: messages -----------------------------------------------
NO_TEXT_MESSAGE = "No extractable text content found in document."
STALE_MESSAGE = "Ingestion interrupted by system restart. Please re-upload."

# Default stop words: the English function words of Spark's own stop-word list,
# without contractions. Longer lists are passed as a parameter.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what which "
    "who whom this that these those am is are was were be been being have has had having do "
    "does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just "
    "don should now"
).split()
