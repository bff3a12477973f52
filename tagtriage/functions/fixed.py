"""Fixed values that must equal the reference's for identical results.

These are data, not logic: word lists, lookup tables and patterns, stated
plainly and in their natural order.
"""

from __future__ import annotations

import unicodedata

# --- fixed values: English stop words (the standard NLTK English list) ---
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# --- fixed values: extra stop words and punctuation tokens of the stop-word step ---
EXTRA_STOP_WORDS = ["https", "metoo", "com", "amp"]
PUNCT_STOP_WORDS = [".", ",", '"', "'", "?", "/", "\\", "!", ":", ";", "(", ")",
                    "[", "]", "{", "}", "%"]
# Python's string.punctuation: a token that is a substring of it is dropped.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: slang table, one "KEY=Phrase" per line, file order ---
SLANG_LINES = """AFAIK=As Far As I Know
AFK=Away From Keyboard
ASAP=As Soon As Possible
ATK=At The Keyboard
ATM=At The Moment
A3=Anytime, Anywhere, Anyplace
BAK=Back At Keyboard
BBL=Be Back Later
BBS=Be Back Soon
BFN=Bye For Now
B4N=Bye For Now
BRB=Be Right Back
BRT=Be Right There
BTW=By The Way
B4=Before
B4N=Bye For Now
CU=See You
CUL8R=See You Later
CYA=See You
FAQ=Frequently Asked Questions
FC=Fingers Crossed
FWIW=For What It's Worth
FYI=For Your Information
GAL=Get A Life
GG=Good Game
GN=Good Night
GMTA=Great Minds Think Alike
GR8=Great!
G9=Genius
IC=I See
ICQ=I Seek you (also a chat program)
ILU=ILU: I Love You
IMHO=In My Honest/Humble Opinion
IMO=In My Opinion
IOW=In Other Words
IRL=In Real Life
KISS=Keep It Simple, Stupid
LDR=Long Distance Relationship
LMAO=Laugh My A.. Off
LOL=Laughing Out Loud
LTNS=Long Time No See
L8R=Later
MTE=My Thoughts Exactly
M8=Mate
NRN=No Reply Necessary
OIC=Oh I See
PITA=Pain In The A..
PRT=Party
PRW=Parents Are Watching
QPSA?\tQue Pasa?
ROFL=Rolling On The Floor Laughing
ROFLOL=Rolling On The Floor Laughing Out Loud
ROTFLMAO=Rolling On The Floor Laughing My A.. Off
SK8=Skate
STATS=Your sex and age
ASL=Age, Sex, Location
THX=Thank You
TTFN=Ta-Ta For Now!
TTYL=Talk To You Later
U=You
U2=You Too
U4E=Yours For Ever
WB=Welcome Back
WTF=What The F...
WTG=Way To Go!
WUF=Where Are You From?
W8=Wait...
7K=Sick:-D Laugher"""

# --- fixed values: keyword labelling functions (name, keywords, vote) ---
# 1 = hijacked, 0 = valid; a function votes when any keyword is a substring
# of the lower-cased text, else abstains (-1).
KEYWORD_LFS = [
    ("food", ["#food", "#foodporn"], 1),
    ("tfb", ["#tfb", "#teamfollowback", "#followgain"], 1),
    ("follow", ["#follow4follow", "#followforfollow", "#likeforlike", "#like4like"], 1),
    ("apple", ["#apple", "#iphone"], 1),
    ("ipad", ["#ipad", "#ipadgames"], 1),
    ("game", ["#ps4live", "#gamer", "#gaming", "#games", "#gamenight", "#videogames"], 1),
    ("women", ["women", "movement", "abuse", "harassment", "victim", "feminism", "feminist"], 0),
]
# The functions the reference actually applies (the women rule is defined only).
ACTIVE_KEYWORD_LFS = ["food", "follow", "tfb", "ipad", "apple", "game"]

# --- fixed values: category tags of the seed files ---
SEED_CATEGORIES = ["Apple", "Food", "Game", "IPad", "Follow", "TFB"]

# --- fixed values: regular expressions shared by Spark (Java) and DuckDB (RE2) ---
URL_MENTION_RE = r"(?:@|https?://)\S+"
SIGN_RE = r"[#@]([\p{L}\p{N}_]+)"
# Emoji class of the reference: its ranges union to U+24C2..U+10FFFF plus
# four single code points below that range.
EMOJI_RE = r"[\x{24C2}-\x{10FFFF}\x{200D}\x{231A}\x{23CF}\x{23E9}]+"
# Emoji-only variant: the same class without the over-wide U+24C2..U+1F251 span.
EMOJI_ONLY_RE = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                 r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F926}-\x{1F937}"
                 r"\x{10000}-\x{10FFFF}\x{200D}\x{2640}-\x{2642}\x{2600}-\x{2B55}"
                 r"\x{23CF}\x{23E9}\x{231A}\x{3030}\x{FE0F}]+")
SLANG_STRIP_RE = r"[^a-zA-Z0-9]+"
# Tweet tokens: URLs, #tags / @names, words with inner apostrophes or
# hyphens, and single other symbols.
TWEET_TOKEN_RE = (r"https?://\S+|[#@][\p{L}\p{N}_]+"
                  r"|[\p{L}\p{N}_]+(?:['\-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]")
WORD_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
ALPHA_TOKEN_RE = r"\p{L}+"


def slang_map() -> dict[str, str]:
    """Key -> phrase; later lines win; lines without '=' never match."""
    out: dict[str, str] = {}
    for line in SLANG_LINES.split("\n"):
        if "=" in line:
            k, v = line.split("=", 1)
            out[k] = v
    return out


def stop_words() -> list[str]:
    return ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS + PUNCT_STOP_WORDS


def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate`` that strip accents.

    Built by rule: every letter in U+00C0..U+024F whose canonical
    decomposition starts with an ASCII letter maps to that letter.
    """
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)
        stripped = "".join(c for c in base if not unicodedata.combining(c))
        if len(stripped) == 1 and stripped.isascii() and stripped.isalpha() and stripped != ch:
            src.append(ch)
            dst.append(stripped)
    return "".join(src), "".join(dst)


# --- fixed values: verb lemma table (irregular forms -> base form) ---
VERB_LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "having": "have",
    "does": "do", "did": "do", "done": "do", "doing": "do",
    "went": "go", "gone": "go", "goes": "go", "going": "go",
    "said": "say", "says": "say", "made": "make", "makes": "make",
    "took": "take", "taken": "take", "takes": "take",
    "came": "come", "comes": "come", "saw": "see", "seen": "see", "sees": "see",
    "knew": "know", "known": "know", "knows": "know",
    "got": "get", "gotten": "get", "gets": "get",
    "gave": "give", "given": "give", "gives": "give",
    "found": "find", "finds": "find", "thought": "think", "thinks": "think",
    "told": "tell", "tells": "tell", "became": "become", "becomes": "become",
    "left": "leave", "leaves": "leave", "felt": "feel", "feels": "feel",
    "brought": "bring", "brings": "bring", "began": "begin", "begun": "begin",
    "kept": "keep", "keeps": "keep", "held": "hold", "holds": "hold",
    "wrote": "write", "written": "write", "writes": "write",
    "stood": "stand", "stands": "stand", "heard": "hear", "hears": "hear",
    "meant": "mean", "means": "mean", "met": "meet", "meets": "meet",
    "ran": "run", "runs": "run", "paid": "pay", "pays": "pay",
    "sat": "sit", "sits": "sit", "spoke": "speak", "spoken": "speak", "speaks": "speak",
    "lay": "lie", "lain": "lie", "led": "lead", "leads": "lead",
    "grew": "grow", "grown": "grow", "grows": "grow", "lost": "lose", "loses": "lose",
    "fell": "fall", "fallen": "fall", "falls": "fall", "sent": "send", "sends": "send",
    "built": "build", "builds": "build", "understood": "understand",
    "spent": "spend", "spends": "spend", "believed": "believe", "believes": "believe",
}
