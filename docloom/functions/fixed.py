"""Word lists, patterns and thresholds that results depend on."""

# Page stamps, redactions, addresses, phones, links, dates, names.
STAMP = r"HOUSE[\s_]*OVERSIGHT[\s_]*\d{4,}"
STAMP_PREFIX = "HOUSE_OVERSIGHT_"
REDACTION = r"_{4,}|\[redacted\]|\bredacted\b|\bnon-responsive\b|\bprivileged\s*-\s*redacted\b"
WORD = r"[A-Za-z][A-Za-z'’\-]+"
EMAIL = r"[\w.\-+]+@[\w\-]+\.[\w.\-]+"
PHONE = r"\(?\b\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b"
URL = r"https?://\S+|www\.\S+"
DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
PROPER_NOUN = r"\b(?:[A-Z][a-z]{1,}\.?\s?){2,}"

# Frequent English words.
COMMON_WORDS = """the of and to in a is that it for was on as with he be at by i this had not
are but from or have an they which one you were her all she there would their we him been has when who will no more if
out so said what up its about into than them can only other new some could time these two may then do first any my now
such like our over man me even most made after also did many before must through back years where much your way well
down should because each just those people mr how too little state good very make world still own see men work long get
here between both life being under never day same another know while last might us great old year off come since
against go came right used take three""".split()

# Abbreviations without vowels.
VOWELLESS_WORDS = """pdf png ppt pptx xls xlsx txt csv htm html https www fwd bcc llp llc nyc fyi pls thx tks mrs hrs
gmt est pst cst edt pdt cdt mdt jpg gif zip wsj nyt cnn cbs nbc bbc gtc phd dept mgmt pymt rcvd""".split()

# Document families, whether their patterns ignore case, and the patterns, in order.
DOC_TYPES = [
    ("court_filing", True, r"\b(IN THE (?:CIRCUIT|DISTRICT|SUPREME) COURT|UNITED STATES DISTRICT COURT|CASE NO|Plaintiff|Defendant|MOTION TO|MEMORANDUM (?:OF|IN)|AFFIDAVIT|SUBPOENA)\b"),
    ("deposition", False, r"\b(DEPOSITION OF|EXAMINATION BY|Q\.\s|A\.\s|VIDEOTAPED DEPOSITION|CERTIFIED (?:COURT )?REPORTER)\b"),
    ("email", True, r"(^|\n)\s*(From:|To:|Sent:|Subject:|Cc:)\s"),
    ("correspondence", True, r"\b(Dear (?:Mr|Ms|Mrs|Dr|Judge)\.?|Sincerely,|Very truly yours|VIA (?:FACSIMILE|FEDERAL EXPRESS|EMAIL))\b"),
    ("financial", True, r"\b(Invoice|Wire Transfer|Account (?:No|Number)|Balance Sheet|USD [\d,]+|Statement of Account|Trust Agreement)\b"),
    ("flight_or_travel", True, r"\b(Flight (?:No|Log|Manifest)|Passenger|Departure|Arrival|Tail Number|N\d{3}[A-Z]{2}\b|Itinerary)\b"),
    ("news_or_book", False, r"\b(Chapter \w+|Copyright ©|All rights reserved|Vanity Fair|The New York Times|Associated Press)\b"),
]

# Names.
TITLE = r"^(mr|mrs|ms|miss|dr|prof|professor|judge|justice|senator|sen|rep|hon|sir|dame|president|amb|ambassador|gov|governor|atty|attorney|det|officer)\.?\s+"
SALUTATION = r"^(dear|hi|hello|hey|thanks|thank|dearest|attn|re|fw|fwd|i)\b"
JUNK = r"redacted|non-responsive|house\s*oversight|https?|www\.|\.com\b|@"
MOSTLY_DIGITS = r"^\W*\w*\d{3,}\w*\W*$"
ORG_SUFFIX = r"\b(inc|incorporated|llc|llp|lp|pllc|plc|ltd|limited|co|corp|corporation|company|group|holdings|partners|associates|pc|pa|sa|nv|ag|gmbh)\b"
NON_PERSON_HEADER = r"mailer|daemon|postmaster|no ?reply|href|http|smtp|newsletter|notification|\bgps\b|\d"
ENTITY_TYPES = ("PERSON", "ORG", "GPE")
LABEL_FOLD = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "GPE", "LOC": "GPE", "FAC": "GPE"}

# Mail headers.
HEADER_KEYS = "From To Cc CC Bcc Sent Date Subject Attachments Importance".split()
NAME_STOPWORDS = ("", "-", "undisclosed recipients", "redacted", "privileged", "unknown")
FORWARD_MARKER = r"-{2,}\s*(?:Original Message|Forwarded message|Begin forwarded message)\s*-{0,}"
HEADER_GAP = 400
EMPTY_SUBJECTS = ("", "<no subject>", "no subject", "none", "(no subject)")

# Thresholds.
TARGET_WORDS, OVERLAP_WORDS = 350, 60
REDACTION_JOIN = 4
PERSON_FUZZ, ORG_FUZZ, ADDRESS_FUZZ = 88, 94, 85
EVIDENCE_CAP, SUBJECT_CAP = 20, 3
THREAD_WINDOW_DAYS, MIN_THREAD_MESSAGES = 30, 2
CORPUS_YEARS = (1990, 2021)
MIN_ENTITY_DF, MIN_PAIR_DF, MIN_PAIR_DOCS, MIN_NPMI = 3, 3, 2, 0.2
MAX_ENTITIES_PER_CHUNK, MAX_ENTITY_TOKENS = 60, 6
NEIGHBOUR_LIMIT, EXPLORE_LIMIT, SECOND_HOP_LIMIT = 8, 5, 3
HUB_DEGREE = 50
