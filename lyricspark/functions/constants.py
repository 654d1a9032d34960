"""Default rule tables, word lists and patterns. Every operator takes its table as a parameter."""

# Word corrections by category; a later category is optional (aggressive mode).
SLANG_RULES = {
    "pants": "bands", "pant": "band", "lizzy": "glizzy", "chopper": "choppa", "drako": "draco", "skirt": "skrrt",
    "skirts": "skrrt", "burr": "brrr", "will": "whip", "ops": "opps", "op": "opp", "well": "12",
}
EXPLICIT_RULES = {"groups": "bitch", "beaches": "bitches", "benches": "bitches"}

# Words whose final g becomes an apostrophe, and two more dialect words.
DIALECT_ING = (
    "doing going rolling riding sliding walking talking keeping blowing looking cooking booking trapping whipping dripping "
    "sipping gripping hitting sitting getting letting catching matching flipping tripping popping dropping stopping hopping "
    "shooting moving proving loving fucking sucking ducking bucking running gunning stunning coming bumping jumping pumping "
    "dumping playing saying staying paying laying slaying praying spraying swinging bringing ringing singing stinging banging "
    "hanging slanging landing standing handing banding flying trying dying lying crying buying disappearing"
).split()
DIALECT_RULES = {w: w[:-1] + "'" for w in DIALECT_ING} | {"hey": "aye", "hay": "aye"}
CONTEXT_WORDS = ("her", "thing", "still", "fly", "na", "well", "yeah")

#: What the rules with a context put for a word, and the texts near it that call for the last of them.
IN_CONTEXT = {"well": "12", "her": "hoes", "na": "nigga"}
CONTEXT_HINTS = ("try", "gang", "jam", "young", "ass", "can't")

# Ordered phrase corrections (pattern, replacement).
PHRASE_RULES = (
    (r"\bit's\s+my\s+watch\s+it's\s+my\s+watch\s+it's\s+my\b", "is it my watch is it my watch is it my"),
    (r"\bit's\s+my\s+watch,?\s+it's\s+my\b", "is it my watch is it my"),
    (r"\bit's\s+my\s+sauce,?\s+it's\s+my\b", "is it my sauce is it my"),
    (r"\bit's\s+my\s+bitch,?\s+it's\s+my\b", "is it my bitch is it my"),
    (r"\bit's\s+my\s+will\b", "is it my whip"),
    (r"\bit's\s+my\s+thang\b", "is it my fit"),
    (r"\bpants\s+up\b", "bands up"),
    (r"\bgot\s+my\s+pants\b", "got my bands"),
    (r"\bgot\s+them\s+pants\b", "got them bands"),
    (r"\bgot\s+the\s+pants\b", "got the bands"),
    (r"\bgot\s+new\s+bands\b", "got them bands"),
    (r"\bnew\s+bands\s+up\b", "them bands up"),
    (r"\bwhy\s+this\s+hoes\b", "all these hoes"),
    (r"\bwhy\s+this\s+her\b", "all these hoes"),
    (r"\ball\s+these\s+her\s+gon", "all these hoes gon'"),
    (r"\bthese\s+her\s+gon", "these hoes gon'"),
    (r"\bher\s+gon'\s+flock\b", "hoes gon' flock"),
    (r"\bher\s+gon'\s+talk\b", "hoes gon' talk"),
    (r"\bher\s+gon'\s+fly\b", "hoes gon' flock"),
    (r"\bnow\s+she\s+wanna\b", "know she wanna"),
    (r"\bnot\s+because\s+i\s+got\b", "now because i got"),
    (r"\bjam\s+us,?\s+well\b", "jam up 12"),
    (r"\bjam\s+up\s+well\b", "jam up 12"),
    (r"\bstick\s+won't\s+jam\s+us\b", "stick won't jam up"),
    (r"\bstill\s+won't\s+jam\b", "stick won't jam"),
    (r"\bbe\s+like,?\s+i'm\b", "be lame i'm"),
    (r"\bniggas?\s+be\s+like\b", "niggas be lame"),
    (r"\bas\s+best\s+we\b", "bitch we"),
    (r"\bgroups\s+like\b", "bitch like"),
    (r"\byour\s+groups\b", "your bitch"),
    (r"\byour\s+needs\s+it\b", "your knees and"),
    (r"\byour\s+needs\s+and\b", "your knees and"),
    (r"\bknow\s+your\s+needs\b", "on your knees"),
    (r"\bone\s+of\s+one\b", "1 of 1"),
    (r"\bone\s+on\s+one\b", "1 of 1"),
    (r"\bthat\s+rain\b", "that range"),
    (r"\bthe\s+rain\b", "the range"),
    (r"\bsame\s+thing\b", "same thang"),
    (r"\bmy\s+thing\b", "my thang"),
    (r"\bdo\s+my\s+thing\b", "do my thang"),
    (r"\bdoin'\s+my\s+thing\b", "doin' my thang"),
    (r"\bi\s+keeping\b", "i'm keepin'"),
    (r"\bi\s+walking\b", "i'm walkin'"),
    (r"\bi\s+doing\b", "i'm doin'"),
    (r"\bi\s+going\b", "i'm goin'"),
    (r"\bbitch,?\s+she\s+wanna\b", "bet she wanna"),
)

# Contractions and slang expanded to standard English.
CONTRACTIONS = {
    "i'm": "i am", "you're": "you are", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are",
    "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have", "i'll": "i will", "you'll": "you will",
    "he'll": "he will", "she'll": "she will", "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would",
    "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "don't": "do not",
    "doesn't": "does not", "didn't": "did not", "won't": "will not", "wouldn't": "would not", "can't": "cannot", "couldn't": "could not",
    "shouldn't": "should not", "ain't": "is not", "y'all": "you all", "let's": "let us", "that's": "that is", "what's": "what is",
    "here's": "here is", "there's": "there is", "who's": "who is", "how's": "how is", "where's": "where is",
}
SLANG_EXPANSIONS = {
    "ima": "I'm gonna", "imma": "I'm gonna", "finna": "fixing to", "gonna": "going to", "wanna": "want to", "gotta": "got to",
    "tryna": "trying to", "kinda": "kind of", "sorta": "sort of", "lemme": "let me", "gimme": "give me", "dunno": "don't know",
    "ion": "I don't", "aint": "ain't",
}
CAPITALIZED = ("i", "i'm", "i'll", "i've", "i'd")

# Words to mask, in order.
CENSORED = (("fuck", "f***"), ("shit", "s***"), ("bitch", "b****"), ("ass", "a**"), ("damn", "d***"), ("hell", "h***"), ("nigga", "n****"), ("niggas", "n****s"))

# Ordered metadata patterns of lyric pages, and keywords of editorial lines.
METADATA_PATTERNS = (
    (r"\d+\s*Contributors?(?:Translations?[A-Za-zÀ-ÿА-яёЁ\s]*)?", "contributor_header"),
    (r"(?:^|\n)[A-Z][A-Za-z0-9\s'\-()]*Lyrics(?:\n|$)", "lyrics_header"),
    (r"(?:Español|Русский\s*Russian|Português|Italiano|Français|Türkçe|azərbaycan|Polski|Deutsch|한국어|日本語|中文)", "translation_tag"),
    (r"(?:…\s*)?Read More\.?", "read_more"),
    (r"(?:^|\n)(?:[\"“].*?[\"”]\s+(?:talks about|is about|describes|explores|features|samples|references).*?)(?:\n|$)", "description_quote"),
    (r"(?:^|\n).*?(?:released|dropped)\s+(?:the\s+)?(?:song|track|single|album|video)\s+(?:on|in)\s+\w+\s+\d+.*?(?:\n|$)", "release_info"),
    (r"\(Prod(?:uced)?\.?\s+(?:by\s+)?[^)]+\)", "prod_credit"),
    (r"\d*\s*Embed\s*$", "embed_marker"),
    (r"You might also like", "you_might_like"),
    (r"See\s+\w+\s+Live", "see_live_ad"),
    (r"https?://\S+", "url"),
    (r"Get tickets as low as \$\d+", "ticket_ad"),
)
EDITORIAL_KEYWORDS = (
    "released", "single", "album", "billboard", "chart", "certified", "platinum", "gold", "record", "producer", "featuring",
    "sampled", "interpolat", "remix", "music video", "directed", "debuted", "peaked", "nominated", "grammy", "award", "viral",
    "snippet", "instagram", "twitter", "tiktok", "streaming", "spotify", "apple music", "soundcloud", "youtube", "contributor",
    "annotation", "defined by merriam", "widely regarded", "physical altercation", "star-studded", "following year", "teasing a snippet",
)
METADATA_FLAGS = (
    (r"\d+\s*Contributors?", "contributor_header"),
    (r"Translations?(?:Español|Русский|Português|Italiano|Français|Türkçe)", "translation_tags"),
    (r"Read More", "read_more"),
    (r"Lyrics$", "lyrics_suffix"),
    (r"You might also like", "genius_ad"),
    (r"\d*\s*Embed\s*$", "embed_marker"),
)

# Slang and ad-lib words of the error categories, and of the slang and ad-lib metrics.
CATEGORY_SLANG = (
    "finna", "tryna", "bussin", "cap", "no cap", "bet", "bruh", "fam", "drip", "ice", "whip", "plug", "opp", "opps", "guap",
    "bands", "hunnid", "rack", "racks", "stack", "stacks", "peel", "slide", "glizzy", "choppa", "blicky", "stick", "pole", "heat",
    "strap", "thot", "simp", "lit", "fire", "mid", "sus", "vibes", "lowkey", "highkey", "deadass", "word", "facts", "aight",
    "ight", "nah", "ion", "ima", "boutta", "gotta", "wanna", "gonna", "coulda", "shoulda", "woulda", "aint", "ain't", "yuh",
    "yah", "skrt", "skrrt", "grrah", "brrr", "gang", "dawg", "shawty", "shorty", "lil", "big", "young", "yung", "diss", "flex",
    "finesse", "clout", "sauce", "draco", "bando", "trap", "juug", "lick", "whippin", "trappin", "sippin", "grippin",
    "drippin", "hittin",
)
CATEGORY_ADLIBS = (
    "skrt", "skrrt", "yeah", "yuh", "aye", "ay", "brr", "brrr", "grrah", "grr", "pow", "bang", "woo", "gang", "let's go",
    "sheesh", "ugh", "huh", "what", "ooh", "ah", "oh", "damn",
)
SLANG_TERMS = (
    "finna", "gonna", "wanna", "gotta", "tryna", "ima", "imma", "ion", "aint", "ain't", "bout", "ya", "yo", "yuh", "ayy", "aye",
    "yeah", "skrt", "brr", "woo", "sheesh", "bussin", "cap", "fire", "lit", "dope", "sick", "bet", "facts", "lowkey", "highkey",
    "drip", "flex", "swag", "ice", "bread", "bands", "guap", "racks", "stacks", "homie", "dawg", "bruh", "fam", "bro", "plug",
    "opps", "nigga", "niggas", "shit", "fuck", "bitch", "ass", "damn",
)
SLANG_VARIANTS = {
    "finna": ("gonna", "fixing to", "about to"), "bussin": ("busting", "bustin"), "ima": ("i'm gonna", "i'm going to", "imma"),
    "ion": ("i don't", "i dont"), "tryna": ("trying to", "tryin to"), "aint": ("ain't", "isn't", "aren't"),
    "yuh": ("yeah", "yah", "ya"), "ayy": ("aye", "ay", "hey"),
}
ADLIB_TERMS = (
    "yeah", "yuh", "yah", "ya", "ayy", "aye", "ay", "hey", "uh", "um", "ah", "skrt", "skrrt", "brr", "brrr", "woo", "wooo",
    "sheesh", "gang", "what", "huh", "ok", "okay", "let's go", "lesgo", "facts", "word", "yo",
)

# Stop words of the overlap scores; the audit leaves out the last.
STOPWORDS = (
    "i", "im", "a", "the", "and", "in", "on", "my", "me", "to", "it", "is", "that", "you", "we", "he", "she", "they", "this",
    "got", "get", "like", "just", "up", "no", "so", "but", "all", "yeah", "yuh", "uh", "oh", "ay", "ayy", "ooh", "what",
)
AUDIT_STOPWORDS = STOPWORDS[:-1]

# Specials of the vocabularies, and ARPAbet vowels and consonants.
SPECIALS = ("<blank>", "<unk>", "<sos>", "<eos>", "<pad>")
PHONEME_SPECIALS = ("<blank>", "<sos>", "<eos>", "<unk>", "<pad>")
VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()
CONSONANTS = "B CH D DH F G HH JH K L M N NG P R S SH T TH V W Y Z ZH".split()
PHONEMES = (*PHONEME_SPECIALS, *(v + s for v in VOWELS for s in ("", "0", "1", "2")), *CONSONANTS, " ")

# Augmentations (name, type).
AUGMENTATIONS = (
    ("speed_slow", "speed"), ("speed_fast", "speed"), ("pitch_down", "pitch"), ("pitch_up", "pitch"), ("noise_light", "noise"),
    ("slow_pitchdown", "combo"), ("fast_pitchup", "combo"),
)

# Sounds and words that count as the same when heard (word, variants).
PHONETIC_PAIRS = {
    "th": ("d", "t", "f", "v"), "dat": ("that",), "dem": ("them",), "dey": ("they",), "dis": ("this",), "in": ("ing",),
    "nothin": ("nothing",), "somethin": ("something",), "doin": ("doing",), "bout": ("about",), "cause": ("because", "cuz", "cus"),
    "finna": ("fixing to", "gonna", "going to"), "tryna": ("trying to",), "boutta": ("about to",), "ion": ("i don't", "i dont"),
    "aint": ("ain't", "isn't", "is not"), "ima": ("i'm going to", "i'm gonna", "imma"), "imma": ("i'm going to", "i'm gonna", "ima"),
    "bands": ("pants", "pans", "bans"), "glizzy": ("busy", "dizzy", "grisly"), "drip": ("trip", "grip", "drip"), "cap": ("cap", "tap", "cat"),
    "slatt": ("slap", "flat", "slot"), "thang": ("thing", "tang"), "cuh": ("come", "cub", "cut"), "bruh": ("bro", "brother", "brr"),
    "skrrt": ("skirt", "skirt", "shirt"),
}

#: Tokens that a domain vocabulary always holds, in order.
DOMAIN_TOKENS = (
    *"yeah yuh yah uh ay ayy skrt brr woo sheesh gang aye".split(),
    *"finna gonna wanna gotta tryna ima imma ion aint ain't bout 'bout bussin fire lit dope sick cap facts bet lowkey highkey".split(),
    # one entry in the original table, for want of a comma
    "deadhomieshomie",
    *"dawg bruh fam bro sis plug opps bread bands guap racks stacks chip cheddar cheese drip flex swag ice".split(),
    *"the a an is are was were i you he she it we they my your his her our their and but or so if when that".split(),
    *"in on at to for with from got get like know want need come go make take see look all no not just up out".split(),
)
