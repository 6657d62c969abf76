"""Word lists, patterns, limits and replies that the answers depend on."""

from __future__ import annotations

# Fixed values of routing.
SMS_LENGTH = 160
ROUTE_EMERGENCY = ["emergency", "fire", "medical", "injury", "injured", "ambulance", "security threat", "active shooter", "bomb", "evacuation", "collapse"]
GREETINGS = ["hi", "hello", "hey", "howdy", "greetings", "good morning", "good afternoon", "good evening", "sup", "yo"]
REPLY_GREETING = "Welcome to Summit Connect! Ask about sessions, speakers, venues, or local area info."
REPLY_EMERGENCY = "EMERGENCY: Your message has been flagged. Please contact event security immediately or go to the nearest information desk. If this is a life-threatening emergency, call 911."
REPLY_COMMANDS = {
    "/reset": "Chat history cleared.",
    "/help": "Commands: /help, /status, /schedule, /speakers. Or just text your question!",
    "/schedule": "Text your question about the schedule and I'll find sessions for you!",
    "/speakers": "Text a topic and I'll find relevant speakers and sessions!",
}
REPLY_UNKNOWN = "Unknown command. Commands: /help, /status, /schedule, /speakers. Or just text your question!"

# Fixed values of parsing.
PARSE_EMERGENCY = [
    "emergency", "help", "urgent", "fire", "police", "ambulance", "accident", "danger", "crisis", "disaster", "flood", "earthquake", "hurricane", "tornado", "bomb", "attack",
    "violence", "theft", "robbery", "assault", "rape", "murder", "suicide", "overdose", "heart attack", "stroke", "unconscious", "bleeding", "injured",
]
PARSE_GREETING = ["hello", "hi", "hey", "good morning", "good afternoon", "good evening", "greetings", "dear", "sir", "madam"]
PARSE_QUESTION = ["?", "what", "how", "when", "where", "why", "who", "which", "can you", "could you", "would you", "do you know", "tell me", "explain", "describe"]
PARSE_COMMAND = ["send", "get", "find", "search", "show", "list", "give me", "provide", "deliver", "fetch"]
PARSE_INFORMATION = ["information", "info", "details", "about", "tell", "explain"]
CATEGORIES = {
    "weather": ["weather", "temperature", "rain", "sunny", "cloudy", "storm", "forecast"],
    "news": ["news", "update", "latest", "happening", "event", "story"],
    "education": ["learn", "teach", "school", "education", "study", "course", "lesson"],
    "health": ["health", "doctor", "hospital", "medicine", "sick", "illness", "treatment"],
    "transport": ["bus", "train", "flight", "transport", "travel", "route", "schedule"],
    "government": ["government", "official", "service", "permit", "license", "document"],
}
LOCAL_WORDS = ["local", "nearby", "here", "this area", "community", "city", "town"]
SPAM = ["free", "win", "click here", "limited time", "act now"]
LANGUAGE_MARKS = {"es": ["hola", "gracias", "por favor", "español"], "fr": ["bonjour", "merci", "français"]}
#: Letters and digits of any script, white space and these marks stay in a cleaned text.
CLEAN_MARKS = "?.,!@#$%^&*()+=-_|~`[]{}:;\"'<>/\\"
US_PHONE = r"\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
INTL_PHONE = r"\+?[1-9]\d{1,14}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
NUMBER = r"\b\d+\b"
DATES = [r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b"]

TOO_LONG = "Message too long: %d characters (max 160)"
EMPTY = "Message is empty"
SPAM_WARNING = "Message contains potential spam indicators"
SHORT_HINT = "Consider providing more context for better assistance"
MARKS_HINT = "Consider adding punctuation for clarity"

# Fixed values of the treasure hunt: replies by name.
HUNT = {
    "hint_early": "You haven't started the hunt yet. Text HUNT to begin.",
    "no_hint": "No hint available.",
    "clue_early": "Text HUNT to start the treasure hunt first.",
    "locked": "You haven't unlocked Clue {asked} yet. Solve Clue {state} first.",
    "no_clue": "Clue not found.",
}

# Fixed values of the privacy screen: name, pattern, category, sensitivity.
PII = [
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "contact", "medium"),
    ("email", EMAIL, "contact", "medium"),
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b", "identifier", "high"),
    ("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "financial", "high"),
    ("address", r"(?i)\b\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln)\b", "location", "medium"),
    ("bank_account", r"(?i)\b(?:account|acct|routing)\s*#?\s*\d{8,12}\b", "financial", "high"),
    ("medical_id", r"(?i)\b(?:patient|medical|hospital|clinic)\s*#?\s*\d{4,8}\b", "medical", "high"),
    ("passport", r"\b[A-Z]{2}\d{6,9}\b", "identifier", "high"),
]
RISK = {"high": 10, "medium": 5, "low": 2}

# Fixed values of keyword extraction.
STOP_WORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between",
    "among", "under", "over", "this", "that", "these", "those", "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "whose", "where", "when", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just",
    "should", "now"
]

# Fixed values of response scoring.
WEIGHTS = {"keyword": 0.25, "entity": 0.25, "forbidden": 0.15, "length": 0.10, "latency": 0.10, "repetition": 0.15}
PASS_AT = 0.5

# Fixed values of the conference corpus: printf templates of its documents' texts.
CORPUS_TEXTS = {
    "schedule_overview": "%s runs %s at %s.",
    "schedule_block": "%s \u2014 %s: %s. Location: %s.",
    "schedule_speaker": " Presented by %s.",
    "session": "Session: %s. Track: %s. Day %s, %s, Room %s. Type: %s. %s",
    "speaker": "Speaker: %s, %s at %s. %s Speaking at %s session(s).",
    "venue": "Main venue: %s, %s. Amenities: %s.",
    "level": "Level %s: %s.",
    "hotel": "Hotel: %s, %s from venue. %s %s.",
    "shuttle": "Shuttle available.",
    "restaurant": "Restaurant: %s (%s), %s from venue. Price: %s.",
    "transport": "Transport: %s %s %s %s",
    "weather": "Weather in %s: July average high %s, low %s. %s",
    "emergency": "Emergency: Event security \u2014 %s. First aid at %s. Local emergency: %s. Nearest hospital: %s. Pharmacy: %s.",
    "attraction": "%s (%s), %s from venue: %s",
}
