"""Word lists, lookup tables, thresholds and patterns that results depend on."""

# Token patterns of the corpus and of the collocation counter.
TOKEN_PATTERN = r"[A-Za-z][A-Za-z'-]*|[ÄÖÜäöüß][a-zäöüß]*"
PHRASE_TOKEN_PATTERN = r"[A-Za-z']+"

# Stop words of the corpus cleaner.
STOP_WORDS = """
the a an and or but if then else for of in on at to from by with without
is are was were be been being have has had do does did will would can could
should may might must this that these those
i you he she it we they me him her us them my your his its our their
not no yes so very just about as into
""".split()

# Function words of the collocation counter; the word filter has "man" besides.
FUNCTION_WORDS = """
the a an of in on at to for with by from as and or but if then else
is are was were be been being have has had do does did will would can could
should may might must this that these those it its he she they we you i
me him her them us my your his our their not no yes so very just about
into which what who whom whose when where why how there here all only such more
most much many some any each every own one two upon within without through between
among itself himself herself themselves myself ourselves thus hence therefore however though
although since while until before after
""".split()
FILTER_WORDS = [*FUNCTION_WORDS, "man"]

# Function words of the reports.
REPORT_WORDS = """
the a an of in on at to for and or but with by from as is are was were be been being
have has had do does did will would can could should may might must this that these those
it its he she they we you i me him her them us not no so if then else
""".split()

# Phrases that are no collocations.
BLOCKED_PHRASES = [
    "of the", "in the", "on the", "to the", "for the", "with the",
    "by the", "from the", "at the", "and the", "is the", "was the",
    "are the", "were the", "be the", "has the", "have the", "it is",
    "this is", "that is", "there is", "there are", "in a", "of a",
]

# Irregular forms and their lemmas.
IRREGULAR_LEMMAS = {
    "housewives": "housewife", "wives": "wife", "lives": "life",
    "knives": "knife", "leaves": "leaf", "thieves": "thief",
    "selves": "self", "halves": "half", "shelves": "shelf",
    "studies": "study", "bodies": "body", "parties": "party",
    "men": "man", "women": "woman", "children": "child",
    "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "went": "go", "meant": "mean", "said": "say", "made": "make",
    "took": "take", "came": "come", "became": "become", "gave": "give",
    "found": "find", "thought": "think", "brought": "bring",
    "goes": "go", "does": "do", "has": "have",
}

# Words in -s that are no plurals, words in -ing that are words of their own.
S_WORDS = """
news maths means series species politics physics economics ethics logistics aesthetics
scissors trousers glasses headquarters
""".split()
ING_WORDS = """
evening morning meaning beginning following building wedding meeting opening ceiling offspring
interesting surprising amazing engineering marketing accounting consulting training
""".split()

# Derivational suffixes; evidence that makes a word a term of the book.
DERIVATIONAL_SUFFIXES = ["tion", "sion", "ment", "ness", "ity", "ance", "ence", "ization", "isation", "ism", "ology", "ship", "hood", "ery", "able", "ible", "ous", "ive", "ical"]
TERM_TFIDF, TERM_FREQ = 0.5, 5

# Levels in order, their difficulty, vocabulary sizes and family shares; weights of the difficulty score.
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]
LEVEL_DIFFICULTY = {"A1": 0.05, "A2": 0.20, "B1": 0.40, "B2": 0.60, "C1": 0.80, "C2": 0.95}
LEVEL_VOCABULARY = {"A1": 800, "A2": 1800, "B1": 3500, "B2": 5500, "C1": 6500, "C2": 10000}
LEVEL_SHARE = {"A1": 0.10, "A2": 0.25, "B1": 0.40, "B2": 0.55, "C1": 0.70, "C2": 0.85}
ZIPF_LEVELS = [(6.5, "A1"), (5.5, "A2"), (4.5, "B1"), (3.5, "B2"), (2.5, "C1")]

# Zipf threshold by exam and score; level that a score stands for when learning.
EXAM_ZIPF = {
    "ielts": {6.5: 3.8, 7.0: 4.0, 7.5: 4.23, 8.0: 4.5},
    "toefl": {80: 3.9, 100: 4.2, 110: 4.5},
    "cet4": {425: 3.6, 550: 3.9},
    "cet6": {425: 3.8, 520: 4.1, 600: 4.4},
    "kaoyan": {40: 3.7, 55: 4.0, 70: 4.23, 85: 4.5},
    "tem4": {60: 3.8},
    "tem8": {60: 4.2},
    "gaokao": {90: 3.5, 120: 3.8, 135: 4.1},
}
EXAM_LEVELS = {
    "ielts": {5.5: "B1", 6.0: "B1", 6.5: "B2", 7.0: "B2", 7.5: "C1", 8.0: "C1", 8.5: "C2", 9.0: "C2"},
    "toefl": {60: "B1", 80: "B2", 90: "B2", 100: "C1", 110: "C1", 120: "C2"},
    "cet4": {425: "B1", 550: "B1", 600: "B2"},
    "cet6": {425: "B1", 520: "B2", 600: "C1"},
    "kaoyan": {40: "B1", 55: "B2", 70: "B2", 85: "C1"},
    "tem4": {60: "B2", 80: "C1"},
    "tem8": {60: "C1", 80: "C2"},
    "gaokao": {90: "A2", 120: "B1", 135: "B2"},
}

# Exam, least and greatest score of a band, level of the band.
EXAM_BANDS = [
    ("ielts", 0, 3.0, "A1"), ("ielts", 3.5, 4.0, "A2"), ("ielts", 4.5, 5.0, "B1"), ("ielts", 5.5, 6.0, "B2"), ("ielts", 6.5, 7.0, "C1"), ("ielts", 7.5, 9.0, "C2"),
    ("toefl", 0, 31, "A2"), ("toefl", 32, 45, "B1"), ("toefl", 46, 79, "B2"), ("toefl", 80, 100, "C1"), ("toefl", 101, 120, "C2"),
    ("cet4", 0, 249, "A1"), ("cet4", 250, 349, "A2"), ("cet4", 350, 424, "B1"), ("cet4", 425, 549, "B1"), ("cet4", 550, 710, "B2"),
    ("cet6", 0, 349, "A2"), ("cet6", 350, 424, "B1"), ("cet6", 425, 519, "B1"), ("cet6", 520, 599, "B2"), ("cet6", 600, 710, "C1"),
    ("kaoyan", 0, 39, "A2"), ("kaoyan", 40, 54, "B1"), ("kaoyan", 55, 69, "B2"), ("kaoyan", 70, 84, "C1"), ("kaoyan", 85, 100, "C2"),
    ("tem4", 0, 59, "B1"), ("tem4", 60, 100, "B2"),
    ("tem8", 0, 59, "B2"), ("tem8", 60, 100, "C1"),
    ("gaokao", 0, 59, "A1"), ("gaokao", 60, 89, "A2"), ("gaokao", 90, 119, "B1"), ("gaokao", 120, 134, "B2"), ("gaokao", 135, 150, "C1"),
]
PRESETS = [
    ("cet4-425", "cet4", 425), ("cet4-550", "cet4", 550), ("cet6-425", "cet6", 425), ("cet6-520", "cet6", 520), ("cet6-600", "cet6", 600),
    ("gaokao-120", "gaokao", 120), ("gaokao-130", "gaokao", 130), ("gaokao-135", "gaokao", 135),
    ("ielts-5.5", "ielts", 5.5), ("ielts-6.0", "ielts", 6.0), ("ielts-6.5", "ielts", 6.5), ("ielts-7.0", "ielts", 7.0), ("ielts-7.5", "ielts", 7.5), ("ielts-8.0", "ielts", 8.0),
    ("kaoyan-55", "kaoyan", 55), ("kaoyan-70", "kaoyan", 70), ("kaoyan-85", "kaoyan", 85), ("tem4-pass", "tem4", 60), ("tem8-pass", "tem8", 60),
    ("toefl-100", "toefl", 100), ("toefl-110", "toefl", 110), ("toefl-80", "toefl", 80), ("toefl-90", "toefl", 90),
]

# Common function and content words of the test for joined words, and joined words seen.
JOIN_FUNCTION = """
the of in on at to for and or but if then else is are was were be been being
have has had do does did will would can could should may might must this that these
those it its he she they we you i me him her them us my your his our their
not no so very just about into which what who when where why how there here all only
such more most much many some any each every one two upon within without through between
then than as with from by a an
""".split()
JOIN_CONTENT = """
have has had will would should could can say said see look know think want get go
come make take give find feel become seem word words thing things time way man men
woman women life world hand eye face head mother father name house heart mind day year
back read write book page her him them one two three first every such same own
other another never always often ever even still already yet now then here there
skin nerve mother young readers women men nixon york yale penn harvard washington
translate receive submit specify represent social sexual surprise talk tawton
""".split()
JOINED = """
wouldhave withher whatyou wayout tothis toread theword thetwo thereal talkingabout suchan sothat
someother sheis seeu onthis ofhuman youwent youwear youshould yourskin yournerves yourmother
yourcontested youbreak yetwhat yetshe yeteven yearsearlier yearsafter yorktimes wrongwith wrongnote
zig-zagyet zippedup zippycollege zombievoice yourselfand youngadults youngreader youngreaders
youngwomen youngwriter youngmen youngadult youngwoman
ofthe inthe bemore inher themiddle thesedays notthe ofhim herto halfan isno goback awoman
tobe asa lan-guage lan-guages
""".split()

# Words that stand for more than they say, and the roots of such compounds.
NOTABLE_WORDS = """
watershed breakthrough mainstream groundbreaking blueprint landmark milestone cornerstone hallmark trademark
linchpin lynchpin bedrock underpinning touchstone litmus flashpoint crossroads turningpoint foothold
springboard stumblingblock steppingstone whitewash backdrop showcase flagship powerhouse heavyweight lightweight
watchdog gatekeeper frontrunner trailblazer pathfinder trendsetter gamechanger eyeopener headturner heartthrob
soulmate scapegoat whippingboy fallguy laughingstock goldmine moneyspinner cashcow gravy windfall
jackpot bonanza paydirt motherlode skeletonkey masterkey passkey opensesame shortcut cuttingedge
bleedingedge leadingedge stateoftheart silverlining brightside darkhorse longshot surefire triedandtrue householdname
bigwig bigshot hotshot whizkid prodigy wunderkind risingstar shootingstar
""".split()
METAPHOR_ROOTS = """
star sun earth fire water stone rock ground sky light dark gold silver iron steel heart blood bone hand foot
head eye ear face finger key door gate road path bridge ship horse dog cat bird wolf lion tiger bear fox
""".split()
PLAIN_PREFIXES = ["un", "re", "in", "dis", "mis", "over", "under"]

# Words with a special sense, set phrases, idioms.
POLYSEMOUS = ["spring", "mine", "current", "pound", "bark", "watch", "right", "kind", "mean", "round", "book", "plant", "moonlight"]
SET_PHRASES = [
    "break down", "look forward to", "give up", "take off", "carry out", "come across", "figure out", "point out", "turn out", "set up",
    "bring up", "call off", "put off", "run out of", "make up", "look up", "give in", "work out", "turn on", "turn off",
]
IDIOMS = [
    "a piece of cake", "break a leg", "hit the road", "under the weather", "once in a blue moon", "cost an arm and a leg",
    "let the cat out of the bag", "raining cats and dogs", "spill the beans", "on cloud nine",
]

# Affixes and roots in the order in which they are tried.
PREFIXES = ["pre", "re", "sub", "inter", "trans", "super", "anti", "auto", "bio", "geo", "micro", "multi", "mono", "poly", "tri", "uni", "di", "gen", "hetero", "homo", "pheno", "proto", "tele", "hyper", "hypo", "para"]
SUFFIXES = ["ology", "ism", "tion", "ity", "ment", "ness", "able", "ible", "ous", "ive", "ic", "al", "ize", "type", "some", "like"]
ROOTS = ["gene", "pheno", "allel", "loc", "morph", "herit", "dom", "part", "cess", "spect", "struct"]

# Short codes of parts of speech.
POS_CODES = {
    "n": "n.", "v": "v.", "vt": "v.", "vi": "v.", "aux": "v.", "a": "adj.", "s": "adj.", "adj": "adj.", "r": "adv.", "ad": "adv.", "adv": "adv.",
    "prep": "prep.", "conj": "conj.", "pron": "pron.", "int": "int.", "interj": "int.", "num": "num.", "art": "art.", "abbr": "abbr.", "det": "det.",
    "phr": "phr.", "comb": "comb.", "suf": "suf.", "pref": "pref.", "noun": "n.", "verb": "v.", "adjective": "adj.", "adverb": "adv.",
    "preposition": "prep.", "conjunction": "conj.", "pronoun": "pron.", "interjection": "int.", "numeral": "num.", "article": "art.",
    "auxiliary": "v.", "determiner": "det.", "abbreviation": "abbr.",
}

# ARPAbet symbols in IPA.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɜr", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "r",
    "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
LEVEL_COLOURS = {"A1": "#10b981", "A2": "#22c55e", "B1": "#eab308", "B2": "#f97316", "C1": "#ef4444", "C2": "#7c3aed"}

# Page numbers, citation noise, gloss prefixes, subjects of a file name.
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,8}|\d{1,4}\s*/\s*\d{1,4}|[-–—]?\s*\d{1,4}\s*[-–—]?|page\s+\d{1,4})$"
REFERENCE = r"\s*[\[(]\s*\d+\s*[\])]\s*|\s*[\[(][A-Z][A-Za-z]+\s+\d{4}[\])]\s*"
SUPERSCRIPT = "[¹-¿⁰-₟†*]"
NOTE = r"(?i)\s*\((?:see|cf\.|emphasis|trans\.|note)[^)]*\)\s*"
CONTENTS_LINE = r"(?m)^.*\.{3,}\s*\d+\s*$"
HEADING = r"(?i)^\s*(chapter|part|page|contents|index)\b"
GLOSS_POS = r"(?i)^(?:n\.|v\.|vt\.|vi\.|adj\.|adv\.|ad\.|a\.|r\.|s\.|prep\.|conj\.|pron\.|int\.|interj\.|num\.|art\.|abbr\.|aux\.|det\.|phr\.|comb\.|suf\.|pref\.)\s+"
SUBJECTS = [
    ("phenomen|husserl|heidegger|merleau|jonas|existential|conscious", ["philosophy", "phenomenology"]),
    ("bell jar|plath|novel|fiction|poetry|literature", ["philosophy"]),
    ("biolog|life|cell|gene|organism|molecular", ["biology", "biochemistry", "genetics"]),
    ("physic|quantum|mechanics|thermo|relativit", ["physics"]),
    ("chem|molecule|acid|reaction", ["chemistry"]),
]
ANY_SUBJECT = ["philosophy", "biology", "physics", "chemistry"]

# The spaced-repetition schedule starts and bounds.
START_EASE, LEAST_EASE, FIRST_INTERVALS = 2.5, 1.3, (1, 6)
#: Days; the largest 32-bit number.
LONGEST_INTERVAL = (1 << 31) - 1

# Pronunciations (American, British) of common words without a dictionary.
COMMON_IPA = {
    "the": ("/ðə/", "/ðə/"), "and": ("/ænd/", "/ænd/"), "for": ("/fɔːr/", "/fɔːr/"), "you": ("/juː/", "/juː/"), "this": ("/ðɪs/", "/ðɪs/"),
    "that": ("/ðæt/", "/ðæt/"), "with": ("/wɪð/", "/wɪð/"), "from": ("/frʌm/", "/frʌm/"), "have": ("/hæv/", "/hæv/"), "not": ("/nɒt/", "/nɒt/"),
    "life": ("/laɪf/", "/laɪf/"), "truth": ("/truːθ/", "/truːθ/"), "love": ("/lʌv/", "/lʌv/"), "world": ("/wɜːrld/", "/wɜːld/"), "light": ("/laɪt/", "/laɪt/"),
    "form": ("/fɔːrm/", "/fɔːm/"), "being": ("/ˈbiːɪŋ/", "/ˈbiːɪŋ/"), "consciousness": ("/ˈkɑːnʃəsnəs/", "/ˈkɒnʃəsnəs/"),
    "knowledge": ("/ˈnɑːlɪdʒ/", "/ˈnɒlɪdʒ/"), "experience": ("/ɪkˈspɪriəns/", "/ɪkˈspɪəriəns/"),
}

# Length over which examples count as long on average, and sentences.
LONG_EXAMPLE, LONG_SENTENCE = 60, 80

# Names of accents and of phenomena in rendered entries.
ACCENT_LABELS = {"en_us": "美", "en_uk": "英", "de": "德", "fr": "法", "es": "西", "zh": "汉"}
PHENOMENON_LABELS = {"polysemy": "熟词生义", "slang": "俚语", "collocations": "固定搭配", "domain_term": "学科术语"}

# Parts of speech in the reports.
REPORT_POS = {
    "n": "n.", "noun": "n.", "v": "v.", "verb": "v.", "vt": "v.", "vi": "v.",
    "adj": "adj.", "a": "adj.", "adjective": "adj.", "adv": "adv.", "r": "adv.", "adverb": "adv.",
}

# Signals that a form is a term of the book, and reasons of a decision.
TERM_SIGNS = {"in_definition": "定义句", "in_heading": "标题", "tfidf": "高TF-IDF", "freq": "高频({}次)", "italic": "斜体（外来术语）", "capitalized": "句中大写（专名）"}
FORM_REASONS = {"pos": "派生：POS {}→{}", "derived": "派生后缀", "inflected": "屈折变化", "term": "学术术语促进", "plain": "普通词"}

# Files of the subject dictionaries.
SUBJECT_FILES = {
    "phenomenology": "kaikki_topic_philosophy.jsonl", "philosophy": "kaikki_topic_philosophy.jsonl", "physics": "kaikki_topic_physics.jsonl",
    "chemistry": "kaikki_topic_chemistry.jsonl", "biology": "kaikki_topic_biology.jsonl", "biochemistry": "kaikki_topic_biochemistry.jsonl",
    "genetics": "kaikki_topic_genetics.jsonl", "anatomy": "kaikki_topic_anatomy.jsonl",
}

# What a model may decide about a suspect word; states of learning in their cycle.
DECISIONS = ["repair", "spelling", "proper", "noise", "keep"]
LEARNING_CYCLE = ["new", "learning", "mastered"]

# Seeds of the tagger: words of closed classes, endings that tell a class.
CLOSED_CLASSES = {
    "DET": "the a an this that these those",
    "ADP": "of in to for with on at by from into over under",
    "PRON": "he she it they we you i him her them his their its our your my",
    "CCONJ": "and or but nor",
    "AUX": "is are was were be been has have had do does did will would can could may might must shall should",
    "PART": "not",
}
SURE_ENDINGS = {"NOUN": "tion sion ness ment ity ism", "ADV": "ly", "ADJ": "able ible ous ful ive ical est", "VERB": "ed ing ize"}
