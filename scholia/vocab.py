"""Fixed values that decide results: word lists, thresholds, patterns.

Every value in this module is part of the specification of an operator and is
listed here in its natural order so that it can be read and audited in one
place.
"""

# --- fixed values: words that are never an author surname in a file name -----
FILENAME_COMMON_WORDS = [
    "the", "and", "for", "with", "from", "study", "based", "analysis", "using",
    "method", "results", "research", "journal", "paper", "review", "new", "high", "effect",
    "role", "impact", "approach", "model", "system", "data", "application", "a", "an",
    "of", "in", "on", "by", "to", "is", "it", "as", "at",
    "was", "are", "be", "has", "have", "not", "but", "this", "that",
    "all", "each", "between", "during", "through", "under", "over", "before", "after",
    "above", "below", "out", "off", "up", "down", "about", "into", "than",
    "also", "very", "just", "more", "some", "any", "one", "two", "three",
    "first", "second", "last", "next", "other", "another", "such", "only", "own",
    "same", "so", "too", "well", "even", "still", "already", "however", "although",
    "because", "while", "since", "until", "once", "though", "if", "when", "where",
    "how", "what", "which", "who", "whom", "why", "manuscript", "thesis", "main",
    "draft", "final", "revised", "submitted", "accepted", "published", "preprint", "untitled", "document",
    "file", "figure", "supplement", "supporting",
]

# --- fixed values: words ignored when two titles are compared ----------------
TITLE_STOPWORDS = [
    "a", "an", "the", "of", "and", "for", "in", "on", "with",
    "based", "using", "via", "toward", "towards", "article", "review", "paper", "research",
    "study", "analysis", "method", "approach", "system",
]

# --- fixed values: a line starting with one of these is not a title ----------
PLAIN_TITLE_PREFIXES = [
    "abstract", "introduction", "received", "accepted", "published",
    "doi:", "doi ", "journal", "volume", "page", "copyright",
    "corresponding", "author", "keywords", "available",
]
SCORED_TITLE_PREFIXES = PLAIN_TITLE_PREFIXES + [
    "chapter", "references", "acm", "ccs concepts", "additional key", "index terms",
]

# --- fixed values: substrings that make a line look like a paper title -------
TITLE_HINTS = [
    "survey", "review", "approach", "method", "framework", "model",
    "optimization", "detection", "control", "analysis", "design", "learning",
    "resilient", "based", "using", "for", "toward",
]

# --- fixed values: openings of book, series and contents lines (lower case) --
FRONT_MATTER = (
    r"^(?:chapter|part|the\s+series|series\s+title|risk,\s+systems|series\s+editors|"
    r"edited\s+by|editors?\b|foreword|preface|contents?|contributors|"
    r"about\s+the\s+(?:author|editor)|index\b)"
)
MIN_TITLE_CHARS = 15

# --- fixed values: linkage thresholds and score weights ----------------------
AUTHOR_CHAR_SIMILARITY = 0.7
AUTHOR_MIN_DISTINCT_CHARS = 4
TITLE_SIMILARITY = 0.5
BEST_AUTHOR_BONUS = 50
BEST_YEAR_EXACT_BONUS = 30
BEST_YEAR_NEAR_BONUS = 20
CLUE_AUTHOR_POINTS = 50
CLUE_YEAR_EXACT_POINTS = 30
CLUE_YEAR_NEAR_POINTS = 20
CLUE_KEYWORD_POINTS = 20
AUTO_SCORE = 70
REVIEW_SCORE = 40
TITLE_CANDIDATES = 3
CLUE_CANDIDATES = 5
CACHE_VERSION = 1

# --- fixed values: "no data" markers in extracted JSON ------------------------
MISSING_MARKERS = ["not reported", "none", "null", "n/a", ""]
EXPORT_MISSING_MARKERS = ["not reported", "null", ""]
METADATA_MISSING_MARKERS = ["not reported", ""]
TRUE_MARKERS = ["true", "yes"]
METADATA_KEYS = ["year", "doi", "title", "first_author", "author"]

# --- fixed values: LaTeX ------------------------------------------------------
PROTECTED_ENVIRONMENTS = (
    "figure table tikzpicture pgfplotstable pgfpicture algorithm algorithmic "
    "equation eqnarray align gather multline alignat flalign subfigure subfig"
).split()
HEADING_MARKS = {
    "part": "# ",
    "chapter": "# ",
    "section": "# ",
    "subsection": "## ",
    "subsubsection": "### ",
    "paragraph": "#### ",
    "subparagraph": "##### ",
}
INLINE_MARKS = {
    "textbf": ("**", "**"),
    "textit": ("*", "*"),
    "emph": ("*", "*"),
    "textsf": ("", ""),
    "texttt": ("", ""),
    "textsc": ("", ""),
    "textsuperscript": ("^", ""),
    "textsubscript": ("_", ""),
}
REFERENCE_MARKS = {
    "cite": "[citation]",
    "ref": "[ref]",
    "label": "[label]",
    "pageref": "[pageref]",
    "autoref": "[ref]",
    "eqref": "[eqref]",
}
SPECIAL_CHARACTERS = {
    r"\&": "&", r"\#": "#", r"\$": "$", r"\_": "_", r"\{": "{", r"\}": "}",
    r"\textasciitilde{}": "~", r"\textasciitilde": "~",
    r"\textbackslash{}": "\\", r"\textbackslash": "\\",
    r"\textasciicircum{}": "^", r"\textasciicircum": "^",
    r"\textasciigrave{}": "`", r"\textasciigrave": "`",
    r"\textquotedbl{}": '"', r"\textquotedbl": '"',
    r"\textquoteleft{}": "`", r"\textquoteleft": "`",
    r"\textquoteright{}": "'", r"\textquoteright": "'",
    r"\textdagger": "†", r"\textsection": "§", r"\texteuro": "€",
    r"\textdegree": "°", r"\textellipsis": "...", r"\textemdash": "—",
    r"\textendash": "–", r"\textbullet": "•", r"\P": "¶", r"\S": "§",
    r"\dots": "...", r"\ldots": "...",
}

# --- fixed values: symbols left by page recognition ---------------------------
PAGE_SYMBOLS = {r"\coloneqq": ":=", r"\eqqcolon": "=:", r"\approx": "≈"}
LAYOUT_GRID = 999
