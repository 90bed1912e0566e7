"""Fixed values. Results depend on each of them being exactly as listed."""

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Connectives, counted as substrings of the lower-cased text.
CONNECTIVES = [
    "after", "earlier", "before", "during", "while", "later", "because", "consequently", "thus",
    "both", "additionally", "furthermore", "moreover", "actually", "as a result", "due to", "but",
    "yet", "however", "although", "nevertheless",
]

# Tags of content words.
CONTENT_TAGS = [
    "FW", "JJ", "JJR", "JJS", "NN", "NNS", "NP", "NPS", "RB", "RBR", "RBS",
    "VB", "VBD", "VBG", "VBN", "VBP", "VBZ",
]

# Words the tokenizer splits in two, (head, tail).
CONTRACTIONS = [
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"),
]

# The two fills of each randomly filled column. Both fills of the first column
# are the same text.
COIN_FILLS = {
    "economically_disadvantaged": ("Economically disadvantaged", "Economically disadvantaged"),
    "student_disability_status": (
        "Identified as having disability", "Not identified as having disability"),
    "ell_status": ("Yes", "No"),
    "gender": ("M", "F"),
}

# Lower z bound of each grade on the bell curve; below the last bound is grade 1.
BELL_BOUNDS = [(2.0, 6), (1.5, 5), (0.5, 4), (-0.5, 3), (-1.5, 2)]

# Columns replaced by category codes.
ENCODED = [
    "assignment", "prompt_name", "economically_disadvantaged", "student_disability_status",
    "ell_status", "race_ethnicity", "gender",
]

# Run settings.
TOP_N = 1000
SPLIT_SEED = 42
EXPERIMENT_SEED = 7362
MAX_ITER = 3000
NEIGHBOURS = 6
MIN_SCORE, MAX_SCORE = 1, 6
