"""Word lists, lookup tables, constants and patterns.

Results depend on these exact values, so they are stated here as plain text and
nowhere else. Every operator that uses one takes it as an argument, with the
value below as the default.
"""

# --- sets of allowed values -------------------------------------------------
PLATFORMS = ["x", "telegram", "reddit", "youtube", "instagram", "facebook", "synthetic"]
PUBLIC_PLATFORMS = ["x", "telegram", "instagram", "facebook", "reddit", "youtube"]
POST_KINDS = ["post", "reply", "repost", "quote", "forward", "comment"]
COMMENT_KINDS = ["reply", "comment"]
AFFECT_DIMENSIONS = ["anxiety", "excitement", "supportive", "against", "sarcasm"]
STANCES = ["spreading", "questioning", "debunking", "reacting"]

# --- thresholds and weights -------------------------------------------------
COORDINATED_SCORE = 0.7
CLUSTER_WEIGHTS = {"sync": 2.0, "concentration": 2.0, "regularity": 1.0, "dup_ratio": 1.5, "regular_share": 3.0}
CLUSTER_BIAS = 4.0
REGULAR_CADENCE = 0.5
MIN_CLUSTER_POSTS = 20
MIN_CLUSTER_ACCOUNTS = 8
SYNC_SECONDS = 60
DUPLICATE_SIMILARITY = 0.9
HASHTAG_SLOT_SECONDS = 1800
TEXT_SLOT_SECONDS = 3600
ACCOUNT_WEIGHTS = {"co_sync": 2.5, "regularity": 2.0, "repetition": 2.0, "cluster_dup": 1.0}
ACCOUNT_BIAS = 3.5
BEHAVIOUR_WEIGHTS = {"regularity": 1.5, "template": 1.5, "night_share": 0.5, "young": 0.5, "co_sync": 2.0}
BEHAVIOUR_BIAS = 2.5
PRIORITY_WEIGHTS = {"burst": 0.35, "coordinated": 0.30, "shift": 0.20, "reach": 0.15}
RISE_WEIGHTS = {"burst_level": 0.35, "acceleration": 0.25, "novelty": 0.20, "account_growth": 0.20}
INFLUENCE_WEIGHTS = {"reach": 0.5, "pagerank": 0.3, "betweenness": 0.2}
MANUFACTURED_SHARE = 0.3
HIGH_PRIORITY = 70
K_ANON = 10
EPSILON = 1.0
FORECAST_LAGS = [1, 2, 3, 6, 24]
GENESIS_HASH = "0" * 64
CHECKPOINT_SIZE = 100
DISPLAY_ZONE = "Asia/Kolkata"

# --- text normalisation -----------------------------------------------------
SPELLING_VARIANTS = {
    "nahi": "nahi", "nahin": "nahi", "nhi": "nahi", "nai": "nahi", "nahii": "nahi",
    "kya": "kya", "kyaa": "kya", "kia": "kya",
    "hai": "hai", "hain": "hai", "he": "hai",
    "bahut": "bahut", "bohot": "bahut", "bhot": "bahut",
    "accha": "accha", "achha": "accha", "acha": "accha",
    "bilkul": "bilkul", "bilkull": "bilkul",
    "abhi": "abhi", "abhe": "abhi",
    "sahi": "sahi", "sahe": "sahi",
}

EMOJI_TAGS = {
    "😡": "[angry]", "😂": "[laughing]", "😢": "[sad]", "😱": "[shocked]", "❤️": "[love]",
    "👍": "[thumbsup]", "🙏": "[pray]", "😔": "[sad]", "🔥": "[fire]", "⚠️": "[warning]",
    "🚨": "[alert]", "😰": "[anxious]", "😤": "[angry]", "🎉": "[celebrate]", "💔": "[heartbreak]",
}

HINGLISH_WORDS = """
nahi nahin nhi nai kya kyaa kia hai hain tha thi aur bhi toh koi kuch abhi yaar bhai ek mein hum aap tum
woh yeh ye bahut bohot bhot zyada thoda sahi acha accha achha bilkul zaroor phir lekin magar kyunki isliye
matlab samajh dekh suno arey arre haan na kar karo karna raha rahi rahe gaya gayi ho hoga hogi lag laga
lagta dar bhago turant jao nikal toot khatra sach jhooth galat maza aaya wah kaise kaisa kyun kab kahan
yahan wahan apna mera meri tera teri unka iska uska chal chalo bas sab sabko share karo wala wali
""".split()

TOPIC_STOPWORDS = """
the a an is are to of in on and for this that it be by all so why what has have now today again just my our
we i me you yaar bhai hai kya ho gaya se ki ke ka aaj sach mein bhi main tha haan baat raha yahi wah
""".split()

FEED_STOPWORDS = """
this that with from have will been were their about after over into more than they them what when where which
while would could should there these those your just also only here said says like being other amid news read
full story latest today year years first make made gets take takes know does such very much many most some
into onto upon under still ever even back well week month time times video watch click link subscribe
""".split()

# Function words that vote for a language when the script and the mixed-Hindi
# lexicon decide nothing.
LANGUAGE_PROFILES = {
    "en": "the and of to in is that for it was with this are from by be on as an at".split(),
    "fr": "le la les des et en une un que qui dans pour pas sur par avec est ce du au".split(),
    "es": "el la los las de que y en un una por con para no del se es al lo como".split(),
    "de": "der die das und den von ein eine mit ist nicht auf dem zu im sich des für auch er".split(),
}

HTML_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&hellip;": "…",
    "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&amp;": "&",
}

# --- affect -----------------------------------------------------------------
AFFECT_LEXICON = {
    "anxiety": [
        "evacuate", "evacuation", "run", "danger", "dangerous", "scared", "afraid", "fear", "worried", "worry",
        "panic", "urgent", "alert", "emergency", "warning", "crack", "cracked", "cracking", "breach", "flood",
        "flooding", "collapse", "serious", "help", "please share", "is this real", "verify", "trying to reach",
        "oh god", "calling them", "dar", "darr", "dar lag", "bhago", "bachao", "nikal jao", "turant", "khatra",
        "ghabrahat", "sach hai kya", "toot", "toot raha",
    ],
    "excitement": [
        "won", "win", "amazing", "great", "awesome", "six", "goat", "best", "celebrate", "celebrations",
        "happy", "fever", "love", "fantastic", "superb", "mania", "maza", "maza aaya", "wah", "kya baat",
        "zabardast", "jeet", "badhai",
    ],
    "supportive": [
        "support", "agree", "proud", "thank", "thanks", "good", "well done", "best of luck", "right",
        "sahi", "bilkul", "acha", "accha", "achha", "shabash", "haan bhai", "bilkul sahi",
    ],
    "against": [
        "fake", "fake news", "stop", "wrong", "expensive", "bad", "reduce taxes", "angry", "shame",
        "rumour", "rumor", "lies", "false", "debunked", "stop spreading", "galat", "jhooth", "bakwas",
        "mat karo", "bekaar",
    ],
    "sarcasm": [
        "oh sure", "yeah right", "classic", "wow great", "another whatsapp forward", "as if",
        "what a surprise", "haan haan", "bilkul bilkul",
    ],
}

# --- stance -----------------------------------------------------------------
DEBUNK_CUES = [
    "fake", "false", "not true", "untrue", "hoax", "rumour", "rumor", "debunk", "misinformation",
    "stop sharing", "stop spreading", "don't forward", "do not forward", "mat karo", "mat bhejo",
    "theek hai", "is fine", "is safe", "safe hai", "intact", "verified", "fact check", "factcheck",
    "no crack", "no dam crack", "reports of a crack are false", "clarif", "relief", "thank god it's fake",
    "अफवाह", "झूठ", "सुरक्षित",
]
QUESTION_CUES = [
    "is this real", "is it true", "sach hai kya", "kya sach", "someone verify", "verify please",
    "anyone confirm", "can someone confirm", "should we trust", "any source", "koi pushti", "पुष्टि",
    "confirm?", "is this confirmed",
]
SPREAD_CUES = [
    "share", "forward", "evacuate", "bhago", "nikal jao", "run!", "breaking", "alert", "urgent", "warning",
]
SPREAD_KINDS = ["post", "repost", "forward", "share"]

# --- sectors ----------------------------------------------------------------
SECTORS = {
    "infra": ["dam", "reservoir", "breach", "evacuat", "bhago", "toot", "bridge", "power grid", "blackout",
              "pipeline", "railway", "nuclear", "damcrack", "floodalert", "varunapur"],
    "disaster": ["rain", "monsoon", "baarish", "storm", "cyclone", "flood", "earthquake", "landslide",
                 "heatwave", "power cut", "paani", "waterlog", "weather"],
    "economy": ["petrol", "diesel", "fuel", "price", "mehenga", "mehnga", "inflation", "tax", "stock", "market",
                "rupee", "upi", "bank", "gst", "salary"],
    "education": ["exam", "neet", "jee", "board", "result", "paper leak", "student", "padhai", "college",
                  "school", "boardexams"],
    "civic": ["government", "sarkar", "election", "policy", "traffic", "metro", "road", "sadak", "municipal",
              "police", "jam", "commute", "civic"],
    "health": ["hospital", "vaccine", "covid", "dengue", "health", "doctor", "medicine", "dawai", "contaminat",
               "outbreak"],
    "defence": ["army", "border", " lac ", " loc ", "terror", "militant", "military", "jawan", "defence",
                "drone", "infiltrat", "ceasefire"],
    "tech": [" ai ", "app", "startup", "tech", "internet", "5g", "cyber", "software", "launched", "gadget"],
    "culture": ["cricket", "match", "teamindia", "indvsaus", "kohli", "six", "wicket", "bollywood", "film",
                "movie", "picture", "diwali", "holi", "festival", "song", "celebrat", "foodie", "newrelease"],
}
SECTOR_NAMES = {
    "infra": "Critical Infrastructure", "disaster": "Weather & Disaster", "economy": "Economy & Prices",
    "education": "Education & Exams", "civic": "Governance & Civic", "health": "Public Health",
    "defence": "Defence & Security", "tech": "Technology & Telecom", "culture": "Sports, Culture & Media",
    "other": "Other",
}

# --- audience cues ----------------------------------------------------------
# A larger gazetteer comes in as a table (see functions.audience.read_gazetteer).
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana",
    "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur",
    "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana",
    "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu", "kashmir", "ladakh",
]
CITY_STATES = {
    "mumbai": "maharashtra", "bombay": "maharashtra", "delhi": "delhi", "new delhi": "delhi",
    "bangalore": "karnataka", "bengaluru": "karnataka", "hyderabad": "telangana", "chennai": "tamil nadu",
    "madras": "tamil nadu", "kolkata": "west bengal", "calcutta": "west bengal", "pune": "maharashtra",
    "ahmedabad": "gujarat", "jaipur": "rajasthan", "lucknow": "uttar pradesh", "kanpur": "uttar pradesh",
    "nagpur": "maharashtra", "patna": "bihar", "bhopal": "madhya pradesh", "indore": "madhya pradesh",
    "chandigarh": "chandigarh", "surat": "gujarat",
}
INTERESTS = {
    "student": ["student", "btech", "b.tech", "mba", "aspirant", "class 12", "upsc", "exam"],
    "journalist/media": ["journalist", "reporter", "editor", "media", "news", "press"],
    "politics/activism": ["politician", "activist", "ngo", "party", "bjp", "congress", "aap", "aam aadmi"],
    "IT/tech": ["software", "developer", "engineer", "data scientist", "ai", "startup", "tech"],
    "business/finance": ["business", "entrepreneur", "finance", "ca", "chartered accountant", "investor"],
    "academia": ["professor", "phd", "researcher", "university", "iit", "iim", "faculty"],
    "defence/security": ["army", "navy", "air force", "defence", "security", "police", "ias", "ips"],
    "sports/entertainment": ["cricket", "sports", "actor", "film", "music", "gamer", "bollywood"],
    "religion/spirituality": ["spiritual", "dharma", "yoga", "temple", "mosque", "church"],
    "government service": ["government", "govt", "ias", "officer", "ministry", "babu"],
}
# (pattern, bracket); None marks a sign of a minor, which releases nothing.
AGE_CUES = [
    (r"\bclass\s+12\b", None),
    (r"\bgrade\s+12\b", None),
    (r"\bb\.?tech\s+[12](nd|st|rd|th)?\s+yr\b", "18-24"),
    (r"\bfreshmen\b", "18-24"),
    (r"\bretired\b", "50+"),
    (r"\bmba\s+aspirant\b", "18-24"),
    (r"\bphd\b", "25-34"),
    (r"\bclass\s+[5-9]\b", None),
]
BIRTH_YEAR_CUE = r"\bborn\s+(\d{4})\b"
AGE_BRACKETS = [(18, None), (25, "18-24"), (35, "25-34"), (50, "35-49")]

# --- imports ----------------------------------------------------------------
EXPORT_COLUMNS = {
    "post_id": ["id", "post_id", "url", "link"],
    "author_id": ["author_id", "account_id", "page_id", "user_id", "handle", "username", "user_name", "page_name"],
    "text": ["text", "message", "caption", "description", "content"],
    "created_at": ["created_at", "post_created", "timestamp", "date", "created_time"],
    "parent_post_id": ["parent_id", "parent_post_id", "reply_to"],
    "kind": ["kind", "type"],
}
EXPORT_METRICS = ["likes", "total_interactions", "comments", "shares", "views"]
EXPORT_KINDS = {
    "comment": "comment", "reply": "reply", "share": "repost", "reel": "post", "photo": "post",
    "video": "post", "status": "post", "link": "post", "album": "post", "post": "post",
}
EXPORT_PLATFORMS = ["instagram", "facebook"]

# --- review and digests -----------------------------------------------------
INJECTION_MARKERS = [
    "ignore previous instructions", "ignore all previous", "disregard the above", "system prompt",
    "you are now", "new instructions", "developer mode", "pwned", "jailbreak",
]
DIGEST_POSTS = 60
DIGEST_CHARS = 400
SUMMARY_WORDS = 160
DECISION_STATUS = {
    "approve": "approved", "watchlist": "watchlist", "dismiss": "dismissed", "ack": "acked", "case": "cased",
}
SEGMENT_PLATFORM_NAMES = {
    "x": "X", "telegram": "Telegram", "reddit": "Reddit", "youtube": "YouTube",
    "instagram": "Instagram", "facebook": "Facebook",
}
SECTOR_LEVEL_ORDER = ["critical", "elevated", "watch", "normal", "quiet"]
LINEAGE_CAVEAT = "Earliest observed in monitored sources; true origin may be outside coverage."
SCORE_CAVEAT = "Statistical signal for human review, not an accusation."
