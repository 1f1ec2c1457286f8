"""Word lists, patterns and tables that decide results. They are data; nothing is computed here."""

# Words that keyword extraction leaves out.
STOP_WORDS = """the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will
would could should may might can this that these those i you he she it we they me him her us them my your his its our
their myself yourself himself herself itself ourselves yourselves themselves""".split()
GENERIC_WORDS = """such find sources article citations information content text data example case way time place thing part people
work life world year day man woman child person group number back see get make come give take use look know want say
tell ask feel try leave put""".split()
# Words that concept mining leaves out.
CONCEPT_STOPS = """this that with have will from they been were said would could should their there where which what when while
whom whose your yours such some many most much more less other another different various several certain particular
specific general common similar related important significant major minor large small great good best better first last
next previous following above below question answer example instance case situation context content text document
information data approach method technique process system model framework concept idea thing things element elements
time times year years century period phase moment today tomorrow yesterday recent current type types kind kinds form
forms part parts aspect aspects feature features characteristic characteristics property properties quality qualities
nature basis between among within through during before after relationship relationships connection connections""".split()
CONCEPT_GENERIC = ["thing", "stuff", "item", "object", "entity"]
COMMON_CAPITALS = ["The", "This", "That", "These", "Those", "And", "Or", "But"]

# Answer extraction, in the order tried.
CHOICE_PATTERNS = [r"(?im)(?:answer is|answer:|^)\s*([ABCD])\b", r"(?im)\b([ABCD])\)", r"(?im)\(([ABCD])\)", r"(?im)^([ABCD])\.", r"(?im)\b([ABCD])\b(?=\s|$)"]
NUMBER_PATTERNS = [
    r"(?i)(?:answer is|answer:|equals?|=)\s*([+-]?(?:\d+\.?\d*|\.\d+))", r"(?i)(?:^|\s)([+-]?(?:\d+\.?\d*|\.\d+))(?:\s|$|\.)",
    r"(?i)\$([+-]?(?:\d+\.?\d*|\.\d+))", r"(?i)([+-]?(?:\d+\.?\d*|\.\d+))%",
]
SHORT_ANSWER_PREFIXES = [r"(?i)^(?:the answer is|answer:|it is|this is|that is)\s*", r"(?i)^(?:based on|according to).*?[,:]?\s*"]
CODE_PATTERNS = [
    r"def\s+\w+\s*\(", r"function\s+\w+\s*\(", r"class\s+\w+\s*\{", r"\w+\s*=\s*\w+\s*\(", r"import\s+\w+", r"from\s+\w+\s+import",
    r"if\s*\(.+\)\s*\{", r"for\s*\(.+\)\s*\{", r"while\s*\(.+\)\s*\{", r"console\.log\(", r"print\s*\(",
]
MATH_PATTERNS = [r"\d+\s*[\+\-\*\/]\s*\d+", r"=\s*\d+", r"\b(equation|formula|calculate|solve)\b", r"\b(sin|cos|tan|log|ln|sqrt)\b", r"\b\d+%", r"\$\d+", r"\b\d+\.\d+\b"]

# Weighted patterns of corpus classification, types in declared order.
WEIGHTED_PATTERNS = {
    "mathematical": [
        (r"\d+\s*[\+\-\*\/]\s*\d+\s*=", 10.0), (r"\\frac\{.*?\}\{.*?\}", 9.0), (r"\$[^\$]+\$", 8.0), (r"solve\s+for\s+[a-z]\b", 8.0),
        (r"\b(calculate|compute|equation|formula)\b", 6.0), (r"\b(integral|derivative|matrix|vector)\b", 6.0), (r"\b(sin|cos|tan|log|ln|sqrt)\b", 5.0),
        (r"\d+\s*[\+\-\*\/\^]\s*\d+", 5.0), (r"\b(sum|product|mean|median)\b", 3.0), (r"\b\d+\.?\d*%", 2.0),
    ],
    "code_generation": [
        (r"```[a-z]+\n", 10.0), (r"def\s+\w+\([^)]*\):", 10.0), (r"function\s+\w+\([^)]*\)\s*\{", 9.0), (r"class\s+\w+[:\(\{]", 9.0),
        (r"import\s+\w+|from\s+\w+\s+import", 7.0), (r"\b(return|print|console\.log)\b", 5.0), (r"if\s*\([^)]+\)|for\s*\([^)]+\)", 5.0), (r"\b(var|let|const|int|string|bool)\b", 3.0),
    ],
    "factual_qa": [
        (r"\b(who|what|when|where|why|how)\s+(is|was|did|does)\b", 8.0), (r"\b(capital of|president of|founded in|invented by)\b", 8.0),
        (r"\b(born|died|founded|established|created)\s+in\s+\d{4}", 6.0), (r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 4.0), (r"\b\d{4}\b", 2.0),
    ],
    "domain_knowledge": [
        (r"\b(definition|concept|theory|principle)\s+of\b", 7.0), (r"\b(according to|research shows|studies indicate)\b", 5.0),
        (r"\b(methodology|framework|approach|model)\b", 4.0), (r"\b(analysis|evaluation|assessment)\b", 2.0),
    ],
}
# Counted patterns of the older classifier.
COUNTED_PATTERNS = {
    "mathematical": [r"\d+\s*[\+\-\*\/]\s*\d+", r"equation|formula|calculate|solve", r"equals?|=", r"\b\d+%|\$\d+"],
    "code_generation": [r"def\s+\w+\(|function\s+\w+\(", r"import\s+\w+|from\s+\w+\s+import", r"class\s+\w+:|public\s+class", r"if\s*\(|while\s*\(|for\s*\("],
    "factual_qa": [r"\b(who|what|when|where|why|how)\b", r"\b(president|capital|founded|invented)\b", r"\b\d{4}\b", r"\b(company|organization|person)\b"],
    "domain_knowledge": [r"\b(definition|concept|theory|principle)\b", r"\b(according to|research shows|studies indicate)\b", r"\b(methodology|approach|framework)\b"],
    "summarization": [r"\b(summary|abstract|overview|conclusion)\b", r"\b(in summary|to summarize|in conclusion)\b", r"key points|main ideas|highlights"],
}
# Evaluation types with whether they are deterministic, how they are verified, and their metrics.
EVAL_TYPES = [
    ("mathematical", True, "exact_match", ["accuracy", "pass_rate"]),
    ("code_generation", True, "execution", ["pass_rate", "syntax_correctness"]),
    ("factual_qa", True, "exact_match", ["accuracy", "f1_score"]),
    ("multiple_choice", True, "exact_match", ["accuracy", "normalized_accuracy"]),
    ("summarization", False, "similarity", ["rouge_l", "bleu", "semantic_similarity"]),
    ("translation", False, "similarity", ["bleu", "chrf", "semantic_similarity"]),
    ("creative_writing", False, "llm_judge", ["coherence", "creativity", "fluency"]),
    ("commonsense_reasoning", True, "exact_match", ["accuracy"]),
    ("reading_comprehension", False, "similarity", ["f1_score", "exact_match", "semantic_similarity"]),
    ("domain_knowledge", True, "exact_match", ["accuracy", "precision", "recall"]),
]

# What each weighted pattern stands for, in the same order.
WEIGHTED_NAMES = {
    "mathematical": ["complete equations", "LaTeX fractions", "LaTeX inline math", "explicit solve problems", "math keywords", "advanced math", "math functions",
                     "arithmetic operations", "basic math terms", "percentages"],
    "code_generation": ["code blocks with language", "Python functions", "JavaScript functions", "class definitions", "imports", "code keywords", "control flow", "type keywords"],
    "factual_qa": ["question patterns", "factual phrases", "historical facts", "proper names", "years"],
    "domain_knowledge": ["academic terms", "research language", "domain terms", "analytical terms"],
}
# The long list of the older classifier; its other types are those of COUNTED_PATTERNS.
LONG_MATH_PATTERNS = [
    r"\d+\s*[\+\-\*\/\^]\s*\d+", r"\d+\s*[\+\-\*\/\^]\s*\(\d+\)", r"\(\d+\s*[\+\-\*\/\^]\s*\d+\)",
    r"\b(equation|formula|calculate|solve|compute)\b", r"\b(equals?|equal to|=)\b", r"\b(sum|product|difference|quotient|fraction)\b",
    r"\b(root|square root|cube root|sqrt)\b", r"\b(exponent|power|logarithm|log|ln)\b", r"\b(integral|derivative|differentiate|integrate)\b",
    r"\b(trigonometric|sin|cos|tan|sine|cosine|tangent)\b", r"\b(matrix|vector|determinant|eigenvalue|eigenvector)\b",
    r"\b(probability|statistics|variance|standard deviation|mean|median)\b", r"\b(theorem|proof|lemma|corollary|axiom)\b", r"\b(geometry|algebra|calculus|arithmetic)\b",
    r"\b\d+%|\$\d+", r"[<>=≤≥≠≈∞]", r"±|∓|×|÷|∑|∏|∫|∂|∇|Δ|π|θ|φ|α|β|γ",
    r"\\frac\{.*?\}\{.*?\}", r"\\sqrt\{.*?\}", r"\\sum_\{.*?\}\^\{.*?\}", r"\\int_\{.*?\}\^\{.*?\}", r"\\lim_\{.*?\}", r"\$.*?\$", r"\\\(.*?\\\)", r"\\\[.*?\\\]",
    r"\\begin\{(equation|align|matrix|pmatrix|bmatrix)\}", r"\d+/\d+", r"\d+:\d+", r"\b(ratio|proportion|percentage)\b", r"\{.*?\}",
    r"\\cup|\\cap|\\subset|\\superset|\\in|\\notin", r"\\forall|\\exists|\\neg|\\land|\\lor|\\implies",
    r"\b(polynomial|exponential|factorial|binomial)\b", r"\b(limit|continuity|convergence|divergence)\b", r"\b(linear|quadratic|cubic|quartic)\b", r"n!|\d+!", r"x\^\d+|x\^n|x\^[a-z]",
]
# Content signals; patterns, weight of the word count, whether case matters.
SIGNAL_PATTERNS = {
    "math_density": ([
        r"\b(equation|formula|theorem|proof|lemma|corollary)\b", r"\b(calculate|compute|solve|derive|integrate|differentiate)\b",
        r"\b(function|variable|constant|parameter|coefficient)\b", r"\b(matrix|vector|scalar|tensor|determinant)\b", r"[=≈≠><≤≥±∫∑∏√]",
        r"\b\d+\s*[+\-*/^]\s*\d+\b", r"\b(sin|cos|tan|log|exp|sqrt)\s*\("], 0.1, False),
    "code_density": ([
        r"\b(def|function|class|interface|struct)\s+\w+", r"\b(import|require|include|using|from)\s+\w+", r"\b(if|else|elif|for|while|switch|case)\s*[\(\{]",
        r"\b(return|yield|break|continue|pass)\b", r"[a-zA-Z_]\w*\s*\([^)]*\)\s*[{:]", r"\b(int|str|bool|float|char|void|var|let|const)\b",
        r"[=!<>]=|[+\-*/]=|\+\+|--"], 0.08, True),
    "technical_density": ([
        r"\b[A-Z]{2,}\b", r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b", r"(?U)\b\w+[-_]\w+\b", r"\b(system|process|method|technique|algorithm|protocol)\b",
        r"\b(architecture|framework|infrastructure|implementation)\b"], 0.15, True),
    "factual_density": ([
        r"\b(is|was|are|were|has|have|had)\s+(a|an|the)\b", r"\b(located|founded|established|created|discovered|invented)\b",
        r"\b(in\s+\d{4}|during|between\s+\d{4})", r"\b(consists of|composed of|made up of|includes)\b", r"\b(known as|called|named|referred to as)\b"], 0.1, False),
    "narrative_density": ([
        r"\b(story|narrative|tale|account|describes)\b", r"\b(character|protagonist|antagonist|setting)\b", r"\b(begins|continues|concludes|ultimately)\b",
        r"\b(however|although|despite|nevertheless)\b"], 0.1, False),
}
CODE_BLOCK_MARKS = r"(?m)```|`[^`]+`|^\s{4,}\w+"
STRUCTURE_FLAGS = {
    "has_code_blocks": r"(?m)```|^\s{4,}\w+\(|^\t\w+", "has_formulas": r"[∫∑∏√±≈≠≤≥]|\$.*\$|\\[a-z]+\{", "has_lists": r"(?m)^\s*[\d•\-\*]\s*\w+",
    "has_diagrams": r"(?i)\b(figure|diagram|chart|graph|illustration)\s+\d+",
}
CONCRETE_WORDS, ABSTRACT_WORDS = r"(?i)\b(object|thing|person|place|time|number)\b", r"(?i)\b(concept|idea|theory|principle|notion|abstraction)\b"
# Questions suggested and least validation score by type; shares of answer types.
SUGGESTED = {
    "mathematical": (30, 0.8, {"numeric_exact": 0.7, "string_exact": 0.2, "free_text": 0.1}), "code_generation": (25, 0.7, {"code": 0.9, "free_text": 0.1}),
    "factual_qa": (50, 0.75, {"string_exact": 0.5, "free_text": 0.4, "numeric_exact": 0.1}), "domain_knowledge": (40, 0.6, {"free_text": 0.8, "string_exact": 0.2}),
    "reading_comprehension": (35, 0.55, {"free_text": 0.7, "string_exact": 0.3}), "multiple_choice": (50, 0.7, {"multiple_choice": 1.0}),
}
# Kinds of prompts by patterns, in the order tried.
PROMPT_KINDS = {
    "mathematical": [r"calculate|compute|solve|find|what is \d+", r"equation|formula|algebra|geometry", r"\d+[\+\-\*\/]\d+"],
    "code_generation": [r"write.*function|implement|code|program", r"python|javascript|java|c\+\+", r"algorithm|data structure"],
    "factual_qa": [r"what is|who is|when did|where is", r"define|explain|describe", r"capital|president|inventor"],
    "creative_writing": [r"write.*story|create.*poem|compose", r"creative|imaginative|fictional", r"once upon a time|in a world"],
    "reading_comprehension": [r"according to.*passage|based on.*text", r"the passage states|the text mentions", r"summarize|main idea"],
}
# Question types by patterns, in the order that breaks ties, and the methods each suggests.
QUESTION_PATTERNS = {
    "numerical": [r"\b(how many|how much|what (?:is|was) the (?:number|age|year|percentage|amount))\b", r"\b(minimum|maximum|average|total|count)\b", r"\b\d+\s*(?:years?|percent|%|times?)\b"],
    "definitional": [r"\b(what (?:is|does|means?)|define|meaning of|definition)\b", r"\b(technical (?:name|term)|terminology)\b", r"\b(explain what|describe what)\s+\w+\s+(is|means?)\b"],
    "factual_exact": [r"\b(what (?:is|was) the (?:name|title|date|place))\b", r"\b(who (?:is|was|wrote|created|invented))\b", r"\b(when (?:did|was|is))\b"],
    "factual_variations": [r"\b((?:common|alternative|other) names?)\b", r"\b(also (?:known|called|referred))\b", r"\b(variations?|forms?|types?)\b"],
    "enumerative": [r"\b(list|enumerate|name all|what (?:are|were) (?:the|all))\b", r"\b((?:two|three|four|five|multiple) \w+)\b", r"\b(examples? of|types? of|kinds? of)\b"],
    "descriptive": [r"\b(how (?:is|was|are|were) \w+ (?:depicted|shown|represented))\b", r"\b(describe|characterize|typical(?:ly)?)\b", r"\b(appearance|characteristics?|features?)\b"],
    "conceptual": [r"\b((?:primary|main) (?:purpose|function|role))\b", r"\b(why|explain|significance|importance)\b", r"\b(relationship|connection|influence|impact)\b", r"\b(according to|interpretation|understanding)\b"],
    "multi_part": [r"\b(and what|as well as|additionally|furthermore)\b", r"\b(both \w+ and \w+)\b", r"\b(first|second|third|finally)\b", r"\b(multiple|several|various) (?:aspects?|components?|parts?)\b"],
}
QUESTION_METHODS = {
    "numerical": ["numerical_match", "numerical_tolerance", "exact_match"], "definitional": ["semantic_similarity", "token_overlap", "fuzzy_match"],
    "factual_exact": ["exact_match", "normalized_match", "fuzzy_match"], "factual_variations": ["fuzzy_match", "partial_match", "semantic_similarity"],
    "enumerative": ["partial_match", "set_match", "token_overlap"], "descriptive": ["semantic_similarity", "token_overlap", "llm_judge"],
    "conceptual": ["semantic_similarity", "token_overlap", "llm_judge"], "multi_part": ["partial_match", "component_match", "semantic_similarity"],
}
# Words left out of content overlap, and words that alone don't make a short answer match.
CONTENT_STOPS = "the a an and or but in on at to for of with by is are was were".split()
NUMBER_WORDS = {"twenty five": "25", "twentyfive": "25", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
# Marks of reasoning, and the default terms of domain scores (callers pass their own domain's).
REASONING_PATTERNS = [
    r"step[s]?\s*\d+", r"first[ly]?|second[ly]?|third[ly]?|finally", r"therefore|thus|hence|consequently", r"because|since|given that", r"calculate|compute|determine",
    r"given information|from the (text|passage|corpus)",
]
CALCULATION_PATTERNS = [r"\d+\s*[+\-*/÷×]\s*\d+", r"=\s*\d+"]
DOMAIN_TERMS = ["etruscan", "villanovan", "liver of piacenza", "corpus speculorum", "fufluns", "bronze", "fascicle", "inscription", "bc", "ad", "archaeological", "ancient", "civilization", "culture"]
DOMAIN_PERIODS = [r"\d+\s*bc", r"\d+\s*ad", r"ancient", r"century", r"period"]
CONTEXT_TERMS = ["etruscan", "archaeological", "ancient", "bronze", "inscription", "civilization", "culture", "historical", "artifact", "discovery"]
MATH_ROUTE_WORDS = ["calculate", "compute", "volume", "percentage", "ratio", "years", "divide", "multiply"]
# Base confidence of a similarity by method.
METHOD_CONFIDENCE = {"token_overlap": 0.8, "character_overlap": 0.6, "levenshtein": 0.9, "ngram": 0.7, "rouge_l": 0.85, "bleu": 0.75, "semantic": 0.95}
# Words that keyword concepts leave out, beyond those of CONCEPT_STOPS' kind.
KEYWORD_STOPS = """this that with have will from they been were what when where which while these those through about after before under over
their there would could should your into very just only also such some many most much more less other another different various several certain
particular specific general common similar related important significant major minor large small great good best better first last next previous
following above below same each every both either neither former latter question answer example instance case situation context content text document
information data thing things element elements item items object time times year years period phase moment today tomorrow yesterday recent current
ancient type types kind kinds form forms part parts aspect aspects feature features basis nature place places area areas region regions location people
person women woman men man someone anyone""".split()
CHUNK_STOPS = "this that with have will from they been were which their".split()
RELATED_STOPS = "these those their there where which while other some such many much more less elements things".split()
TERM_STOPS = """these those which their there where while after before about would could should between within among however therefore because since given using
based according context corpus snippet text passage the this that with have will from they been were into other during often common various""".split()
# Technical terms with their weights, phrases of a domain, cues of definitions.
TECHNICAL_TERMS = [(r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b", 3), (r"\b[a-z]+(?:-[a-z]+)+\b", 2), (r"\b[A-Z]{2,}\b", 2)]
FALLBACK_TERMS = [r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b", r"\b[a-z]+-[a-z]+\b", r"\b[A-Z]{2,}\b"]
MATH_CONCEPTS = ["equation", "function", "variable", "algorithm", "computation"]
NOUN_PHRASES = r"\b(?:[A-Z][a-z]+\s+){1,3}[A-Z][a-z]+\b"
PROPER_NOUNS, PROPER_PHRASES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
DATES, MEASURES, SIZES = r"\b\d+\s*(?:BCE|CE|BC|AD)\b", r"\b\d+\s*(?:by|x)\s*\d+\s*(?:cm|m|in|ft)\b", r"\b\d+\s*(?:cm|m|km|in|by)\s*\d+"
DOMAIN_PHRASES = [r"(?i)\b(?:ancient|ritual|religious|sacred)\s+[a-z]+\b", r"(?i)\b[a-z]+\s+(?:slab|tablet|inscription|calendar|artifact|text)\b", r"(?i)\b[a-z]+\s+(?:ceremony|tradition|practice|society)\b"]
PLACES = r"\b[A-Z][a-z]+\s+in\s+[A-Z][a-z]+\b"
PHRASE_STOPS = ["the", "this", "that", "these", "those", "ancient", "text", "also"]
DEFINITION_CUES = [" is ", " are ", " refers to ", " defined as ", " known as ", " consists of ", " comprises "]
# Question templates.
FACT_TEMPLATES = ["What is {concept}?", "How does {concept} work?", "What are the main characteristics of {concept}?", "Why is {concept} important?", "When is {concept} used?"]
STRATEGY_TEMPLATES = {
    "conceptual": ["What is the fundamental concept behind {}?", "How would you define {} in this context?", "What are the core principles of {}?", "Explain the significance of {} in the domain."],
    "application": ["How would you apply {} in the following scenario: {}?", "What would happen if {} was combined with {}?", "Describe a practical use case for {}.", "How does {} solve the problem of {}?"],
    "comparison": ["Compare and contrast {} with {}.", "What are the similarities and differences between {} and {}?", "How does {} relate to {}?", "What advantages does {} have over {}?"],
    "analytical": ["Analyze the impact of {} on {}.", "What are the implications of {} for {}?", "Evaluate the effectiveness of {} in {}.", "What factors influence {} in the context of {}?"],
    "synthesis": ["How do {}, {}, and {} work together?", "What would be the result of combining {} with {}?", "Create a framework that incorporates {}.", "Design a system that utilizes {}."],
}
STRATEGY_ANSWERS = {
    "conceptual": "{} is a fundamental concept that involves structured processes and systematic approaches",
    "application": "When applying {}, one would typically use data-driven methods and established frameworks",
    "comparison": "Comparing {} with other approaches shows distinct advantages in efficiency and scalability",
    "analytical": "The analysis of {} reveals complex relationships between components and underlying mechanisms",
    "synthesis": "Combining {} with other elements creates enhanced capabilities and improved performance",
}
STRATEGY_BOOST = {"conceptual": 0.0, "application": 0.1, "comparison": 0.0, "analytical": 0.15, "synthesis": 0.2}
STRATEGY_DIFFICULTY = {"application": "advanced", "comparison": "intermediate", "analytical": "advanced", "synthesis": "expert"}
RELATED_TERMS = ["technology", "process", "system", "approach", "method"]
TYPE_TEMPLATES = {
    "factual": ["What is {concept}?", "Define {concept}.", "What are the key characteristics of {concept}?", "Describe {concept} in the context provided."],
    "analytical": ["Why is {concept} important in this context?", "How does {concept} relate to {related_concept}?", "Analyze the role of {concept} in the described process.", "What factors influence {concept}?"],
    "comparative": ["Compare {concept} with {related_concept}.", "What distinguishes {concept} from {related_concept}?", "How does {concept} differ from {related_concept} in this context?",
                    "What are the key differences between {concept} and {related_concept}?"],
    "application": ["How would you apply {concept} to solve a similar problem?", "Give an example of {concept} in practice.", "In what scenarios would {concept} be most effective?",
                    "What are the practical implications of {concept}?"],
    "evaluative": ["Evaluate the effectiveness of {concept} in this scenario.", "What are the strengths and weaknesses of {concept}?", "Is {concept} the best approach for this situation? Why?",
                   "Assess the impact of {concept} on the outcome."],
    "synthesis": ["How do {concept} and {related_concept} work together?", "Integrate {concept} with the other elements described.", "What would result from combining {concept} with {related_concept}?",
                  "Create a unified understanding of {concept} and its connections."],
}
TYPE_ANSWERS = {
    "analytical": "The importance of {concept} lies in...", "comparative": "{concept} differs from {related_concept} in that...", "application": "To apply {concept}, one would...",
    "evaluative": "The effectiveness of {concept} can be evaluated as...", "synthesis": "{concept} integrates with other elements by...",
}
RELATED_FALLBACK = {"mathematical": "{} calculations", "code_generation": "{} implementation", "factual_qa": "{} details"}
GROUNDED_TEMPLATES = {
    "factual_qa": ["What specific function does {c}{t}{e} serve?", "How is {c}{s}{t} described in this context?", "What distinguishing features characterize {c}{e}?"],
    "domain_knowledge": ["What is the significance of {c}{t} in this specific domain?", "How does {c}{e} function within the described system?", "What evidence supports the role of {c}{s}{t}?"],
    "mathematical": ["Calculate the dimensions involving {c}{s}.", "What quantitative relationship exists with {c}{t}?", "Determine the numerical value associated with {c}."],
}
PASSAGE_TEMPLATES = {
    "domain_knowledge": ["How does {c} function in the context described in the passage?", "Explain the significance of {c} based on the given information.",
                         "What role does {c} play in the described system or domain?", "Analyze the relationship between {c} and the main topic discussed."],
    "factual_qa": ["What specific characteristics of {c} are described?", "According to the text, what is {c}?", "What are the key attributes of {c} mentioned in the passage?"],
    "mathematical": ["Based on the relationship involving {c}, what would be the result?", "Calculate the value associated with {c} from the given information."],
}
READING_TEMPLATES = ["What is the main idea?", "What is the significance of {concept}?", "How is {concept} described?", "What conclusion can be drawn?", "What are the key points?"]
DISTRACTORS = {
    "dating": ["Earlier dating of {}", "Later dating related to {}", "Similar artifact to {} from a nearby site"],
    "form": ["Earlier interpretation of {}", "Alternative form of {}", "Related but distinct from {}"],
}
ADVERSARIAL = ["add_distractors", "multi_hop_reasoning", "reverse_statements", "data_to_code_transformation", "temporal_complexity", "causal_chain_extension"]
REVERSED = ["What would happen if {} did NOT exist in this context?", "Which of the following is NOT true about {}?", "Identify what {} is NOT, based on the given information."]
DIFFICULTY_WORDS = ["analyze", "evaluate", "synthesize", "compare", "contrast", "implications", "significance", "relationship", "framework"]
ASKING_WORDS = ["what", "how", "why", "when", "where", "which", "who"]
CODE_WORDS = ["def", "function", "class", "import", "return"]
PLACEHOLDERS = ["...", "todo", "placeholder", "insert here", "fill in"]
BARE_TEXTS = ["what?", "how?", "why?", "yes.", "no.", "maybe."]
GENERIC_QUESTIONS = ["what is it", "how does it work", "why does it"]
EXPECTED_COMPLEXITY = {"basic": 0.2, "intermediate": 0.5, "hard": 0.7, "expert": 0.9}
ISSUE_KINDS = {"Clarity": ["unclear", "ambiguous", "confusing"], "Specificity": ["specific", "detail", "vague"], "Output Format": ["format", "output", "structure"],
               "Instructions": ["example", "guidance", "instruction"]}
ANSWER_TYPES = ["numeric_exact", "numeric_tolerance", "string_exact", "code", "multiple_choice", "boolean", "free_text"]
EXACT_ANSWER_TYPES = ["numeric_exact", "string_exact", "code", "multiple_choice", "boolean"]

# Sample questions of a configuration (question, answer, kind); other types ask for the corpus' concepts.
SAMPLE_QUESTIONS = {
    "mathematical": [("Solve: 2x + 5 = 15", "5", "algebra"), ("What is 25% of 80?", "20", "percentage"), ("Calculate the area of a circle with radius 3", "28.27", "geometry")],
    "code_generation": [
        ("Write a function to reverse a string", "def reverse_string(s): return s[::-1]", "string_manipulation"), ("Implement binary search", "def binary_search(arr, target): ...", "algorithms"),
        ("Create a class for a linked list node", "class ListNode: def __init__(self, val=0): ...", "data_structures"),
    ],
    "factual_qa": [("What is the capital of France?", "Paris", "geography"), ("Who invented the telephone?", "Alexander Graham Bell", "history"), ("What is the chemical symbol for gold?", "Au", "science")],
}
# The name of a verification method's own metric.
METHOD_METRICS = {
    "exact_match": "exact_match", "numerical_match": "numerical_match", "multiple_choice_match": "multiple_choice", "code_match": "code_execution", "semantic_similarity": "semantic_similarity",
    "domain_factual_knowledge": "factual_accuracy", "domain_mathematical_reasoning": "mathematical_accuracy", "latex_match": "latex_match", "expression_match": "expression_match",
}
