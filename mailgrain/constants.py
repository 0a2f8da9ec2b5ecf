"""Fixed values.

Word lists, thresholds, weights and formats in this file have to equal the
published behaviour the operators reproduce; they are data, not logic.
"""

# --- response timing, in seconds (fixed values) ------------------------------
IMMEDIATE_BELOW = 3600
SAME_DAY_BELOW = 86400
NEXT_DAY_BELOW = 172800
STALE_AFTER_DAYS = 7
FREQUENT_SENDER_ABOVE = 20

# --- bounce and auto-reply markers (fixed values) ----------------------------
AUTOMATED_REPLY_SENDERS = [
    "mailer-daemon", "postmaster", "noreply", "no-reply", "donotreply", "autoreply", "auto-reply",
]
AUTOMATED_REPLY_SUBJECTS = ["delivery status notification", "out of office", "automatic reply"]

# --- service detection (fixed values) ----------------------------------------
SERVICE_ADDRESS_WORDS = [
    "noreply", "no-reply", "donotreply", "do-not-reply", "notifications", "notification", "alerts",
    "alert", "mailer", "mail", "newsletter", "updates", "info", "support", "service", "system",
    "automated", "auto", "bounce", "postmaster", "mailer-daemon",
]
# ordered: the first type with a hit wins
SERVICE_TYPE_WORDS = {
    "newsletter": ["newsletter", "digest", "weekly", "daily", "monthly", "subscribe"],
    "transactional": ["order", "receipt", "invoice", "payment", "shipping", "delivery", "confirmation"],
    "notification": ["notification", "alert", "reminder", "update"],
    "marketing": ["offer", "discount", "sale", "promo", "deal", "exclusive"],
    "social": ["linkedin", "facebook", "twitter", "instagram", "social"],
}
IMPORTANT_SUBJECT_WORDS = [
    "order", "shipped", "delivered", "delivery", "payment", "transaction", "confirm", "confirmed",
    "confirmation", "receipt", "invoice", "alert", "security", "verification", "verify", "password",
    "login", "suspicious", "fraud", "unauthorized", "expired", "expiring", "renewal", "bill", "due",
    "overdue", "failed", "declined", "refund", "return",
]
UNIMPORTANT_SUBJECT_WORDS = [
    "offer", "sale", "deal", "save", "discount", "promo", "promotional", "newsletter", "digest",
    "weekly", "daily", "tips", "recommendation", "suggested", "trending", "popular", "new arrivals",
    "just for you", "exclusive", "limited time", "don't miss", "check out",
]
IMPORTANT_SENDER_WORDS = [
    "order", "shipping", "shipment", "tracking", "confirm", "alert", "security", "verify",
    "transaction", "payment", "billing", "receipt", "return", "refund", "delivery", "support",
]

# --- content patterns: name -> (searched field, words) (fixed values) ---------
CONTENT_PATTERNS = {
    "has_request": ("body", ["please", "could you", "can you", "would you", "need you"]),
    "has_scheduling": ("body", ["meeting", "calendar", "schedule", "call", "zoom", "teams"]),
    "has_deadline": (
        "body",
        ["deadline", "by friday", "by monday", "by eod", "end of day", "urgent", "asap", "by tomorrow"],
    ),
    "has_approval": ("body", ["approve", "approval", "sign off", "authorize", "permission"]),
    "has_confirm": ("body", ["confirm", "acknowledge", "let me know", "please reply"]),
    "is_newsletter": ("body", ["unsubscribe", "view in browser", "email preferences", "opt out"]),
    "is_fyi": ("body", ["fyi", "for your information", "just wanted to let you know"]),
    "is_calendar_response": ("subject", ["accepted:", "declined:", "tentative:"]),
    "is_auto_reply": ("subject", ["out of office", "automatic reply", "auto-reply"]),
    "has_attachment_ref": ("body", ["attached", "attachment", "see attached", "please find"]),
}
ORDER_BODY_WORDS = ["order", "receipt", "confirmation", "shipped", "delivered", "tracking"]

# --- senders that are not people, as LIKE patterns (fixed values) -------------
MARKETING_LIKE = [
    "%noreply%", "%no-reply%", "%no_reply%", "%donotreply%", "%@email.%", "%@mail.%", "%@offers.%",
    "%@mailer.%", "%@marketing.%", "%@news.%", "%@info.%", "%newsletter%", "%marketing%", "%alerts@%",
    "%notification%", "%billing@%", "%digest%", "%@google.com", "%@github.com", "%@linkedin.com",
    "%@medium.com", "%@substack.%", "%@mailchimp.%", "%@sendgrid.%", "%update@%", "%support@%",
    "%team@%", "%hello@%", "%contact@%",
]

# --- text cleaning (fixed values) --------------------------------------------
SIGNATURE_MARKERS = [
    "--", "---", "-- ", "—", "Sent from my iPhone", "Sent from my iPad", "Sent from my Android",
    "Sent from Mobile", "Get Outlook for iOS", "Get Outlook for Android", "Sent via ",
    "Sent from Yahoo Mail", "Sent from Gmail", "Best regards,", "Best,", "Thanks,", "Regards,",
    "Cheers,", "Sincerely,",
]
DROPPED_ELEMENTS = [
    "script", "style", "head", "meta", "link", "noscript", "iframe", "object", "embed", "applet",
]
DROPPED_ELEMENTS_BASIC = ["script", "style", "head", "meta", "link"]
HTML_HINTS = ["<html", "<body", "<p", "<div", "<script", "<style", "<table", "<span"]
MAX_TOKENS = 8000
TOKEN_RESERVE = 20
MIN_BODY_TOKENS = 100

# --- clustering: dimension -> largest number of clusters (fixed values) -------
MAX_CLUSTERS = {"people": 15, "content": 100, "behavior": 8, "service": 8, "temporal": 6}
DIMENSIONS = ["people", "content", "behavior", "service", "temporal"]
ACTION_CODES = {"REPLIED": 1, "ARCHIVED": 2, "IGNORED": 3, "PENDING": 4}
TIMING_CODES = {"immediate": 1, "same_day": 2, "next_day": 3, "delayed": 4}
SERVICE_TYPE_CODES = {"transactional": 1, "notification": 2, "newsletter": 3, "marketing": 4, "social": 5}
NO_RESPONSE_HOURS = 168.0

# --- priority blend (fixed values) -------------------------------------------
PRIORITY_WEIGHTS = {
    "feature_score": 0.35,
    "replied_similarity": 0.30,
    "cluster_novelty": 0.20,
    "sender_novelty": 0.15,
}
MIN_SENDER_VECTORS = 3

# --- task extraction (fixed values) ------------------------------------------
URGENCY_SCORES = {"immediate": 1.0, "today": 0.8, "this_week": 0.5, "whenever": 0.2, "none": 0.1}
TASK_TYPES_BY_ACTION = {"task": "other", "reply": "send", "decision": "decision"}
TASK_STATUSES = ["pending", "in_progress", "completed", "dismissed"]
TASK_TYPES = ["review", "send", "schedule", "decision", "research", "create", "follow_up", "other"]
TASK_COMPLEXITIES = ["trivial", "quick", "medium", "substantial", "unknown"]

# --- canonical event types (fixed values) ------------------------------------
USER_OPEN, USER_CLOSE = "turn.user.open", "turn.user.close"
AGENT_OPEN, AGENT_CLOSE = "turn.agent.open", "turn.agent.close"
TEXT_SUBMIT, VOICE_FINAL = "ui.text.submit", "stt.final"

# --- back-fill phases: name, first day, last day, batch size, vectors?, labels?,
#     label limit (fixed values) ----------------------------------------------
BACKFILL_PHASES = [
    ("quick", 0, 7, 100, True, True, 50),
    ("standard", 7, 30, 200, True, True, 100),
    ("deep", 30, 90, 500, False, False, None),
]
