"""Values that other systems rely on. Nothing here is computed."""

from __future__ import annotations

# Status bands used when no settings row overrides them.
DEFAULT_BANDS = [
    {"label": "ممتاز", "min": 100, "color": "#16a34a"},
    {"label": "جيد جدًا", "min": 85, "color": "#0ea5e9"},
    {"label": "جيد", "min": 70, "color": "#3b82f6"},
    {"label": "يحتاج متابعة", "min": 50, "color": "#f59e0b"},
    {"label": "ضعيف", "min": 0, "color": "#ef4444"},
]

# Keyword rules of a fresh installation (phrase, label).
DEFAULT_KEYWORDS = [
    ("تم التواصل خارج النظام", "تواصل خارج النظام"),
    ("ارسل حسابك", "طلب تحويل خارجي"),
    ("تحويل خاص", "طلب تحويل خارجي"),
    ("انتظر الرد", "تأخير رد"),
    ("تم الإلغاء", "إلغاء طلب"),
]

# Texts shown in place of a missing value.
NO_BAND = "—"
NO_LABEL = "-"
NO_EMPLOYEE = "غير محدد"
DEFAULT_KEYWORD_LABEL = "ملاحظة جودة"

# Allowed words of the enumerated columns.
SCOPES = ("employee", "team_leader")
PERIOD_TYPES = ("daily", "weekly", "monthly")
ROLES = ("admin", "manager", "team_leader")
DIRECTIONS = ("inbound", "outbound")
RUN_STATUSES = ("running", "success", "error", "partial")
SEES_ALL = ("admin", "manager")

# Page sizes of the review queue, the notes list and the label chart.
REVIEW_QUEUE_ROWS = 200
NOTES_PAGE_ROWS = 500
LABEL_CHART_ROWS = 8

# Settings read by the public board when a key is missing.
DEFAULT_REFRESH_SECONDS = 20
SESSION_DAYS = 7

# Arabic letters folded one to one, in the order of their replacements below.
FOLDED_LETTERS = "أإآٱةىؤئ"
FOLDED_INTO = "ااااهيوي"
# Fathatan to sukun and the tatweel, deleted from text.
DELETED_MARKS = "ًٌٍَُِّْـ"
DEFINITE_ARTICLE = "ال"
# First and last letter of the range that holds all letters and marks above.
FOLDED_RANGE = "آ-ٱ"
