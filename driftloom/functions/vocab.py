"""Vocabularies, patterns and limits that results depend on."""

# --- Patterns (fixed values). Flags are given once, in RX: case-insensitive, Unicode classes. ---
RX = "(?iU)"
PRICE_SIGNAL = r"\$\s*\d[\d,]*(?:\.\d+)?|per\s+(month|user|seat|agent|mo|hr|hour)\b"
CONCRETE_PRICE = r"\$\s*\d[\d,]*"
FINANCE_CHANNEL = r"stock|invest|market|trading|wallstreet|options|finance|quant|earnings|ipo"
CUSTOMER_SIGNAL = (
    r"\b(review|experience|recommend|worth it|feedback|customer|client|customer service|"
    r"quality|reliable|thinking of|considering|anyone used|anyone use|"
    r"which provider|compare|alternatives?)\b"
)
EMPLOYEE_SIGNAL = (
    r"\b(i work(?:ed)? at|employee|interview|salary|compensation|hiring|"
    r"recruiter|manager|my boss|benefits|pto|layoff|laid off|glassdoor|"
    r"career|job opening|job offer|work culture)\b"
)
PRICING_CALLOUT = (
    r"\b(pric(?:e|ing)|billing|bill(?:ed|ing)?|packag(?:e|ing)|tier|plan|seat|credit|quote"
    r"|/month|per user|\$)\b"
)
NON_MATERIAL_PRICING = (
    r"\b(no concrete|no specific|no customer pricing|none available"
    r"|not about this competitor|different company)\b"
)
IMPRESSIONS_LINE = r"\d[\d,]* ?[-–] ?\d[\d,]* ?impressions"
RUN_DATE_LINE = r"(started|running|active|launched)"
JOB_CLASS = r"(job|position|opening|role|listing|posting)"
AGE_UNITS = (
    "m|min|minute|minutes|h|hr|hour|hours|d|day|days|w|wk|week|weeks|mo|month|months|y|yr|year|years"
)
AGE_TOKEN = rf"\b\d+\s*(?:{AGE_UNITS})\b"
AGE_PARTS = rf"\b(\d+)\s*({AGE_UNITS})\b"
DATE_TOKEN = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2}(?:,\s*\d{4})?\b"
BULLET_MARK = r"^(?:[•\-\*]\s+|\d+[.)]\s+)"
INLINE_BULLET = r"(?:•|\d+[.)])"
HEADING_MARK = r"^#{1,6}\s+"
ACTIVITY_ID = r"activity:(\d+)"
POST_URL_ID = r"/posts/[^/?#]+-(\d+)"
SHARE_ID = r"share:(\d+)"

# --- Word lists (fixed values) ---
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
PRICING_KEYWORDS = ["pricing", "cost", "how much", "quote", "rate", "monthly"]
DISCUSSION_KEYWORDS = [
    "review", "experience", "anyone used", "recommend", "worth it", "customer service",
]
DELETED_BODIES = ["[deleted]", "[removed]"]
BLOCKED_MARKERS = ["/login", "/authwall", "/checkpoint"]
STRIP_TAGS = ["script", "style", "noscript", "nav", "footer", "header", "aside"]
FOCUS_TAGS = ["h1", "h2", "h3", "p", "button", "a"]
SIGNAL_SKIP_PREFIXES = ["step 1", "step 2", "step 3", "extract", "normalize", "synthesize"]
COMPACT_SKIP_PREFIXES = SIGNAL_SKIP_PREFIXES + [
    "important", "based on the provided", "here is the extraction",
]
ENGAGEMENT_KEYS = [
    "likes", "comments", "shares", "views", "upvotes", "retweets", "reactions", "awards",
]
PAYLOAD_LISTS = ["posts", "tweets", "reviews", "data"]
PAGE_STATE_MARKERS = [  # (needle, marker), in check order
    ("sign in", "sign-in"),
    ("join now", "join-now"),
    ("security verification", "security-verification"),
    ("challenge", "challenge"),
    ("something went wrong", "error-banner"),
    ("try again", "retry-prompt"),
    ("no posts yet", "no-posts"),
    ("page isn't available", "page-unavailable"),
    ("this page is unavailable", "page-unavailable"),
]
AD_FORMATS = [  # (needle, format), first hit wins
    ("carousel", "Carousel"), ("video", "Video"),
    ("single image", "Single Image"), ("text ad", "Text"),
]

# --- Vocabularies (fixed values) ---
FORUM_BASE = "https://www.reddit.com"
NETWORK_BASE = "https://www.linkedin.com"
OPEN_STATUSES = ["failed", "skipped"]
PAGE_TYPES = ["homepage", "blog", "pricing", "careers"]
ENDPOINTS = [  # (endpoint, source, is_owned)
    ("reddit_posts", "reddit", False),
    ("linkedin_posts", "linkedin", False),
    ("linkedin_company_posts", "linkedin", True),
    ("facebook_page_posts", "facebook", True),
    ("facebook_page_reviews", "facebook", False),
    ("facebook_search", "facebook", False),
    ("twitter_search", "twitter", False),
    ("twitter_user_tweets", "twitter", True),
]
SOURCE_LABELS = {  # source: (coverage-line label, digest label)
    "linkedin:ads": ("LinkedIn ads", "LinkedIn Ads"),
    "linkedin:organic": ("LinkedIn organic", "LinkedIn Organic"),
    "linkedin:apidirect_fallback": ("LinkedIn (API Direct)", "LinkedIn (API Direct)"),
    "reddit:pricing": ("Reddit pricing intel", "Pricing Intel (Reddit)"),
    "reddit:discussion": ("Reddit customer voice", "Reddit Customer Voice"),
    "reddit:apidirect_fallback": ("Reddit (API Direct)", "Reddit (API Direct)"),
    "twitter:activity": ("Twitter", "Twitter"),
    "twitter:social": ("Twitter commentary", "Twitter Commentary"),
    "facebook:posts": ("Facebook", "Facebook"),
    "facebook:reviews": ("Facebook reviews", "Facebook Reviews"),
    "facebook:social": ("Facebook commentary", "Facebook Commentary"),
    "website:homepage": ("Homepage", "Homepage"),
    "website:blog": ("Blog", "Blog"),
    "website:pricing": ("Pricing page", "Pricing"),
    "website:careers": ("Careers page", "Careers"),
}
COVERAGE_BUCKETS = [  # (source prefix, label), in display order
    ("website", "website"), ("reddit", "Reddit"), ("linkedin", "LinkedIn"),
    ("twitter", "Twitter"), ("facebook", "Facebook"),
]
SUMMARY_COLUMNS = {  # summary type: report column
    "homepage_change": "homepage_change",
    "blog_change": "blog_change",
    "pricing_change": "pricing_change",
    "careers_change": "careers_change",
    "linkedin_ads": "linkedin_ads_summary",
    "linkedin_organic": "linkedin_organic_summary",
    "pricing_research": "pricing_research_summary",
    "reddit_discussion": "reddit_discussion_summary",
    "twitter_activity": "twitter_summary",
    "twitter_social": "twitter_social_summary",
    "facebook_activity": "facebook_summary",
    "facebook_reviews": "facebook_reviews_summary",
    "facebook_social": "facebook_social_summary",
}
EVIDENCE_FIELDS = [  # (label, report column), in order
    ("Homepage", "homepage_change"),
    ("Blog", "blog_change"),
    ("Pricing page", "pricing_change"),
    ("Pricing intel", "pricing_research_summary"),
    ("Reddit discussion", "reddit_discussion_summary"),
    ("LinkedIn ads", "linkedin_ads_summary"),
    ("LinkedIn organic", "linkedin_organic_summary"),
    ("Twitter activity", "twitter_summary"),
    ("Twitter commentary", "twitter_social_summary"),
    ("Facebook activity", "facebook_summary"),
    ("Facebook reviews", "facebook_reviews_summary"),
    ("Facebook commentary", "facebook_social_summary"),
    ("Coverage", "coverage_summary"),
    ("Error", "error"),
]
CARD_MESSAGING = [
    "linkedin_ads_summary", "linkedin_organic_summary", "reddit_discussion_summary",
    "homepage_change", "blog_change",
]
EXEC_MESSAGING = [
    "linkedin_ads_summary", "reddit_discussion_summary", "linkedin_organic_summary",
    "twitter_summary", "twitter_social_summary", "facebook_summary", "facebook_social_summary",
    "homepage_change", "blog_change",
]

# --- Limits (fixed values) ---
MAX_KEYWORDS = 6
MAX_COMMENTARY_QUERIES = 2
MAX_ENRICHED_POSTS = 10
MAX_COMMENTS = 8
MAX_COMMENT_CHARS = 400
MAX_CARDS = 20
MAX_RECENT_DAYS = 7
MONTHLY_LIMIT = 50
SNAPSHOT_DAYS = 180
ITEM_DAYS = 365
TREND_WEEKS = 12
BLOCK_CHARS = 2900
MESSAGE_BLOCKS = 50
FIELD_CHARS = 520
POST_BUDGET = 12_000
CARD_BUDGET = 22_000

# --- Texts (fixed values) ---
NO_MOVEMENT = "- No material competitive movement identified from available signals."
NO_CHANGES = (
    "• No material pricing or messaging changes detected across monitored competitors this week."
)
NO_ENTITIES = "• No competitors were processed in this run."
TRUNCATED_NOTICE = "• Additional points truncated for Slack length."
EXPIRED_EARLIER = "session expired earlier in run"
NOT_NEEDED_NOTE = "pricing page already exposes concrete pricing"
NO_NET_NEW = "• LinkedIn recovery completed, but no net-new LinkedIn ads/posts were detected."
