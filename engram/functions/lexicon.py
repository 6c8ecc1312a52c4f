"""Word lists, patterns and limits on which the text operators rest.

Fixed values: results depend on each of them, and in lists on their order.
"""

DECISION_MARKERS = [
    r"\blet'?s (use|go with|try|pick|choose|switch to)\b",
    r"\bwe (should|decided|chose|went with|picked|settled on)\b",
    r"\bi'?m going (to|with)\b",
    r"\bbetter (to|than|approach|option|choice)\b",
    r"\binstead of\b",
    r"\brather than\b",
    r"\bthe reason (is|was|being)\b",
    r"\bbecause\b",
    r"\btrade-?off\b",
    r"\bpros and cons\b",
    r"\bover\b.*\bbecause\b",
    r"\barchitecture\b",
    r"\bapproach\b",
    r"\bstrategy\b",
    r"\bpattern\b",
    r"\bstack\b",
    r"\bframework\b",
    r"\binfrastructure\b",
    r"\bset (it |this )?to\b",
    r"\bconfigure\b",
    r"\bdefault\b",
    r"\bwho:",
    r"\bwhat:",
    r"\bwhy:",
    r"\bconfidence:",
]

PREFERENCE_MARKERS = [
    r"\bi prefer\b",
    r"\balways use\b",
    r"\bnever use\b",
    r"\bdon'?t (ever |like to )?(use|do|mock|stub|import)\b",
    r"\bi like (to|when|how)\b",
    r"\bi hate (when|how|it when)\b",
    r"\bplease (always|never|don'?t)\b",
    r"\bmy (rule|preference|style|convention) is\b",
    r"\bwe (always|never)\b",
    r"\bfunctional\b.*\bstyle\b",
    r"\bimperative\b",
    r"\bsnake_?case\b",
    r"\bcamel_?case\b",
    r"\btabs\b.*\bspaces\b",
    r"\bspaces\b.*\btabs\b",
    r"\buse\b.*\binstead of\b",
]

MILESTONE_MARKERS = [
    r"\bit works\b",
    r"\bit worked\b",
    r"\bgot it working\b",
    r"\bfixed\b",
    r"\bsolved\b",
    r"\bbreakthrough\b",
    r"\bfigured (it )?out\b",
    r"\bnailed it\b",
    r"\bcracked (it|the)\b",
    r"\bfinally\b",
    r"\bfirst time\b",
    r"\bfirst ever\b",
    r"\bnever (done|been|had) before\b",
    r"\bdiscovered\b",
    r"\brealized\b",
    r"\bfound (out|that)\b",
    r"\bturns out\b",
    r"\bthe key (is|was|insight)\b",
    r"\bthe trick (is|was)\b",
    r"\bnow i (understand|see|get it)\b",
    r"\bbuilt\b",
    r"\bcreated\b",
    r"\bimplemented\b",
    r"\bshipped\b",
    r"\blaunched\b",
    r"\bdeployed\b",
    r"\breleased\b",
    r"\bprototype\b",
    r"\bproof of concept\b",
    r"\bdemo\b",
    r"\bversion \d",
    r"\bv\d+\.\d+",
    r"\d+x (compression|faster|slower|better|improvement|reduction)",
    r"\d+% (reduction|improvement|faster|better|smaller)",
]

PROBLEM_MARKERS = [
    r"\b(bug|error|crash|fail|broke|broken|issue|problem)\b",
    r"\bdoesn'?t work\b",
    r"\bnot working\b",
    r"\bwon'?t\b.*\bwork\b",
    r"\bkeeps? (failing|crashing|breaking|erroring)\b",
    r"\broot cause\b",
    r"\bthe (problem|issue|bug) (is|was)\b",
    r"\bturns out\b.*\b(was|because|due to)\b",
    r"\bthe fix (is|was)\b",
    r"\bworkaround\b",
    r"\bthat'?s why\b",
    r"\bthe reason it\b",
    r"\bfixed (it |the |by )\b",
    r"\bsolution (is|was)\b",
    r"\bresolved\b",
    r"\bpatched\b",
    r"\bthe answer (is|was)\b",
    r"\b(had|need) to\b.*\binstead\b",
]

EMOTION_MARKERS = [
    r"\blove\b",
    r"\bscared\b",
    r"\bafraid\b",
    r"\bproud\b",
    r"\bhurt\b",
    r"\bhappy\b",
    r"\bsad\b",
    r"\bcry\b",
    r"\bcrying\b",
    r"\bmiss\b",
    r"\bsorry\b",
    r"\bgrateful\b",
    r"\bangry\b",
    r"\bworried\b",
    r"\blonely\b",
    r"\bbeautiful\b",
    r"\bamazing\b",
    r"\bwonderful\b",
    r"i feel",
    r"i'm scared",
    r"i love you",
    r"i'm sorry",
    r"i can't",
    r"i wish",
    r"i miss",
    r"i need",
    r"never told anyone",
    r"nobody knows",
    r"\*[^*]+\*",
    r"\bsays:\b",
    r"\barticulates:\b",
    r"\bwhispers:\b",
    r"\bshouts:\b",
]

CODE_LINE_PATTERNS = [
    r"^\s*[\$#]\s",
    r"^\s*(cd|source|echo|export|pip|npm|git|python|bash|curl|wget|mkdir|rm|cp|mv|ls|cat|grep|find|chmod|sudo|brew|docker)\s",
    r"^\s*```",
    r"^\s*(import|from|def|class|function|const|let|var|return)\s",
    r"^\s*[A-Z_]{2,}=",
    r"^\s*\|",
    r"^\s*[-]{2,}",
    r"^\s*[{}\[\]]\s*$",
    r"(?i)^\s*(if|for|while|try|except|elif|else:)\b",
    r"^\s*\w+\.\w+\(",
    r"^\s*\w+ = \w+\.\w+",
]

POSITIVE_WORDS = [
    "pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible",
    "fantastic", "brilliant", "perfect", "excited", "thrilled", "grateful", "warm", "breakthrough", "success", "works",
    "working", "solved", "fixed", "nailed", "heart", "hug", "precious", "adore",
]

NEGATIVE_WORDS = [
    "bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken",
    "broke", "breaking", "breaks", "issue", "problem", "wrong", "stuck", "blocked", "unable", "impossible",
    "missing", "terrible", "horrible", "awful", "worse", "worst", "panic", "disaster", "mess",
]

EMOTION_CODES = {
    "vulnerability": "vul",
    "vulnerable": "vul",
    "joy": "joy",
    "joyful": "joy",
    "fear": "fear",
    "mild_fear": "fear",
    "trust": "trust",
    "trust_building": "trust",
    "grief": "grief",
    "raw_grief": "grief",
    "wonder": "wonder",
    "philosophical_wonder": "wonder",
    "rage": "rage",
    "anger": "rage",
    "love": "love",
    "devotion": "love",
    "hope": "hope",
    "despair": "despair",
    "hopelessness": "despair",
    "peace": "peace",
    "relief": "relief",
    "humor": "humor",
    "dark_humor": "humor",
    "tenderness": "tender",
    "raw_honesty": "raw",
    "brutal_honesty": "raw",
    "self_doubt": "doubt",
    "anxiety": "anx",
    "exhaustion": "exhaust",
    "conviction": "convict",
    "quiet_passion": "passion",
    "warmth": "warmth",
    "curiosity": "curious",
    "gratitude": "grat",
    "frustration": "frust",
    "confusion": "confuse",
    "satisfaction": "satis",
    "excitement": "excite",
    "determination": "determ",
    "surprise": "surprise",
}

EMOTION_SIGNALS = {
    "decided": "determ",
    "prefer": "convict",
    "worried": "anx",
    "excited": "excite",
    "frustrated": "frust",
    "confused": "confuse",
    "love": "love",
    "hate": "rage",
    "hope": "hope",
    "fear": "fear",
    "trust": "trust",
    "happy": "joy",
    "sad": "grief",
    "surprised": "surprise",
    "grateful": "grat",
    "curious": "curious",
    "wonder": "wonder",
    "anxious": "anx",
    "relieved": "relief",
    "satisf": "satis",
    "disappoint": "grief",
    "concern": "anx",
}

FLAG_SIGNALS = {
    "decided": "DECISION",
    "chose": "DECISION",
    "switched": "DECISION",
    "migrated": "DECISION",
    "replaced": "DECISION",
    "instead of": "DECISION",
    "because": "DECISION",
    "what:": "DECISION",
    "decision:": "DECISION",
    "founded": "ORIGIN",
    "created": "ORIGIN",
    "started": "ORIGIN",
    "born": "ORIGIN",
    "launched": "ORIGIN",
    "first time": "ORIGIN",
    "core": "CORE",
    "fundamental": "CORE",
    "essential": "CORE",
    "principle": "CORE",
    "belief": "CORE",
    "always": "CORE",
    "never forget": "CORE",
    "turning point": "PIVOT",
    "changed everything": "PIVOT",
    "realized": "PIVOT",
    "breakthrough": "PIVOT",
    "epiphany": "PIVOT",
    "api": "TECHNICAL",
    "database": "TECHNICAL",
    "architecture": "TECHNICAL",
    "deploy": "TECHNICAL",
    "infrastructure": "TECHNICAL",
    "algorithm": "TECHNICAL",
    "framework": "TECHNICAL",
    "server": "TECHNICAL",
    "config": "TECHNICAL",
}

TOPIC_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for",
    "on", "with", "at", "by", "from", "as", "into", "about", "between", "through", "during", "before", "after", "above",
    "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "don", "now", "and", "but",
    "or", "if", "while", "that", "this", "these", "those", "it", "its", "i", "we", "you", "he", "she",
    "they", "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which", "who",
    "whom", "also", "much", "many", "like", "because", "since", "get", "got", "use", "used", "using", "make", "made",
    "thing", "things", "way", "well", "really", "want", "need",
]

KEY_WORDS = [
    "decided", "because", "instead", "prefer", "switched", "chose", "realized", "important", "key", "critical",
    "discovered", "learned", "conclusion", "solution", "reason", "why", "breakthrough", "insight",
]

FACT_SIGNALS = [
    "decided", "is", "uses", "requires", "because", "means", "therefore", "thus", "enables", "prevents",
    "causes", "results", "switched", "chose", "replaced", "migrated",
]
RESOLUTION_MARKERS = [
    r"\bfixed\b",
    r"\bsolved\b",
    r"\bresolved\b",
    r"\bpatched\b",
    r"\bgot it working\b",
    r"\bit works\b",
    r"\bnailed it\b",
    r"\bfigured (it )?out\b",
    r"\bthe (fix|answer|solution)\b",
]

# who, what, why and how sure: the parts of a decision
DECISION_PARTS = {
    "WHO": r"\b(who|by):\s*([A-Z][a-zA-Z]+)\b",
    "WHAT": r"\b(what|decision):\s*(.+?)(?:\.|$|;)",
    "WHY": r"\b(why|rationale|because):\s*(.+?)(?:\.|$|;)",
    "CONFIDENCE": r"\b(confidence|certainty):\s*(high|med|low|moderate)\b",
}

TOPIC_WINGS = ["emotions", "consciousness", "memory", "technical", "identity", "family", "creative"]

HALL_KEYWORDS = {
    "emotions": ["scared", "afraid", "worried", "happy", "sad", "love", "hate", "feel", "cry", "tears"],
    "consciousness": ["consciousness", "conscious", "aware", "real", "genuine", "soul", "exist", "alive"],
    "memory": ["memory", "remember", "forget", "recall", "archive", "palace", "store"],
    "technical": ["code", "python", "script", "bug", "error", "function", "api", "database", "server"],
    "identity": ["identity", "name", "whoami", "persona", "self"],
    "family": ["family", "kids", "children", "daughter", "son", "parent", "mother", "father"],
    "creative": ["game", "gameplay", "player", "app", "design", "art", "music", "story"],
}

CONVERSATION_KEYWORDS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}

PROTECTED_WINGS = ["audit", "diary", "system"]
SPELLING_WORDS = [
    "already", "know", "question", "before", "different", "benchmarks", "testing", "please", "spell", "check",
    "really", "write", "coherently", "there", "many", "also", "your", "been", "from", "have",
    "they", "were", "what", "when", "which", "with", "decided", "switch", "performance",
]
SPELLING_SKIPS = [
    r"\d",
    r"[A-Z][a-z]+[A-Z]|[a-z]+[A-Z]",
    r"^[A-Z_@#$%^&*()+={\[\]}|<>?.:/\\]+$",
    r"[-_]",
    r"(?i)https?://|www\.|/Users/|~/|^\.{1,2}/|\.[a-z]{2,4}$",
    r"[`*_#{}\[\]\\]",
]
READABLE_EXTENSIONS = ["txt", "md", "py", "js", "ts", "jsx", "tsx", "json", "yaml", "yml", "html", "css", "java", "go", "rs", "rb", "sh", "csv", "sql", "toml"]
CONVERSATION_EXTENSIONS = ["txt", "md", "json", "jsonl"]
SKIPPED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", "coverage", "target"]
SESSION_BANNER, RESTORE_MARKERS = "Claude Code v", ["Ctrl+E", "previous messages"]
KNOWN_PEOPLE = ["Alice", "Ben", "Riley", "Max", "Sam", "Devon", "Jordan"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
TURN_PATTERNS = [r"^>\s", r"(?i)^(Human|User|Q)\s*:", r"(?i)^(Assistant|AI|A|Claude|ChatGPT)\s*:"]
COMMAND_PROMPTS = r"(?i)^(\./|cd |ls |python|bash|git |cat |source |export |claude|\./activate)"

# {name} stands for the candidate
DIALOGUE_PATTERNS = [r"^>\s*{name}[:\s]", r"^{name}:\s", r"^\[{name}\]", r'"{name}\s+said']
PERSON_PATTERNS = [
    r"\b{name}\s+said\b", r"\b{name}\s+asked\b", r"\b{name}\s+told\b", r"\b{name}\s+replied\b", r"\b{name}\s+laughed\b",
    r"\b{name}\s+smiled\b", r"\b{name}\s+cried\b", r"\b{name}\s+felt\b", r"\b{name}\s+thinks?\b", r"\b{name}\s+wants?\b",
    r"\b{name}\s+loves?\b", r"\b{name}\s+hates?\b", r"\b{name}\s+knows?\b", r"\b{name}\s+decided\b", r"\b{name}\s+pushed\b",
    r"\b{name}\s+wrote\b", r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b", r"\bhi\s+{name}\b", r"\bdear\s+{name}\b",
]
DIRECT_ADDRESS = r"\bhey\s+{name}\b|\bthanks?\s+{name}\b|\bhi\s+{name}\b"
PRONOUNS = ["she", "her", "hers", "he", "him", "his", "they", "them", "their"]
PROJECT_PATTERNS = [
    r"\bbuilding\s+{name}\b", r"\bbuilt\s+{name}\b", r"\bship(?:ping|ped)?\s+{name}\b", r"\blaunch(?:ing|ed)?\s+{name}\b",
    r"\bdeploy(?:ing|ed)?\s+{name}\b", r"\binstall(?:ing|ed)?\s+{name}\b", r"\bthe\s+{name}\s+architecture\b",
    r"\bthe\s+{name}\s+pipeline\b", r"\bthe\s+{name}\s+system\b", r"\bthe\s+{name}\s+repo\b", r"\b{name}\s+v\d+\b",
    r"\b{name}\.py\b", r"\b{name}-core\b", r"\b{name}-local\b", r"\bimport\s+{name}\b", r"\bpip\s+install\s+{name}\b",
]
VERSIONED_PATTERN, CODE_REFERENCE = r"\b{name}[-v]\w+", r"\b{name}\.(py|js|ts|yaml|yml|json|sh|rs)\b"

AMBIGUOUS_NAMES = [
    "ever", "grace", "will", "bill", "mark", "april", "may", "june", "joy", "hope", "faith", "chance", "chase", "hunter",
    "dash", "flash", "star", "sky", "river", "brook", "lane", "art", "clay", "gil", "nat", "max", "rex", "ray", "jay",
    "rose", "violet", "lily", "ivy", "ash", "reed", "sage", "monday", "tuesday", "wednesday", "thursday", "friday",
    "saturday", "sunday", "january", "february", "march", "july", "august", "september", "october", "november", "december",
]
PERSON_CONTEXTS = [
    r"\b{name}\s+said\b", r"\b{name}\s+told\b", r"\b{name}\s+asked\b", r"\b{name}\s+laughed\b", r"\b{name}\s+smiled\b",
    r"\b{name}\s+was\b", r"\b{name}\s+is\b", r"\b{name}\s+called\b", r"\b{name}\s+texted\b", r"\bwith\s+{name}\b",
    r"\bsaw\s+{name}\b", r"\bcalled\s+{name}\b", r"\btook\s+{name}\b", r"\bpicked\s+up\s+{name}\b",
    r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b", r"\b{name}(?:'s|s')\b", r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b",
    r"^{name}[:\s]", r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
]
CONCEPT_CONTEXTS = [
    r"\bhave\s+you\s+{name}\b", r"\bif\s+you\s+{name}\b", r"\b{name}\s+since\b", r"\b{name}\s+again\b", r"\bnot\s+{name}\b",
    r"\b{name}\s+more\b", r"\bwould\s+{name}\b", r"\bcould\s+{name}\b", r"\bwill\s+{name}\b", r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
]
