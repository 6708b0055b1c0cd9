"""Fixed values. Everything in this file is text that has to be equal for results to be equal:
token lists, patterns, prompt wording, column names and file headings. No logic lives here.
"""

# Characters that count as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
QUOTES = "\"'"
# The same white space as a character class; needs the (?U) flag.
SPACE = r"[\s\x1c-\x1f]"

WILDCARD = "<*>"
MARKER = "TEMPLATE:"

# Special tokens dropped from model output, in this order.
SPECIAL_TOKENS = [
    "<unk>", "</s>", "<s>", "<|im_start|>", "<|im_end|>",
    "<|begin_of_text|>", "<|system|>", "<|user|>", "<|assistant|>",
]

# Template phrases, tried in this order.
TEMPLATE_PHRASES = [
    "final template",
    "resulting template",
    "generated template",
    "log template",
    "template",
    "the template is",
]
# Words that may introduce a template on its own line.
LINE_OPENERS = ["template", "the template", "here is", "this is", "output", "result", "so"]
# A template line has more than 5 and less than 300 characters.
LINE_LENGTH = (6, 299)

# Reasoning text: what is cut, and the longest summary kept.
THINK_END = "</think>"
FENCED = r"(?s)```.*?```"
STEP_LINE = r"(?dU)## Step \d+:.*?\n"
BOXED_MATH = r"(?s)\$\\boxed\{(.*?)\}\$"
BOXED = r"(?s)\$?\\boxed\{(.*?)\}\$?"
SUMMARY_MARKER = "error_summary:"
SUMMARY_LIMIT = 1000
SUMMARY_MIN = 10
SUMMARY_CAP = {"reasoner": 200, "chat": 300}

# Label replies that cannot be used.
API_ERROR = "API_Error"
NO_RESPONSE = "No_Response"
EMPTY_RESPONSE = "Empty_Response"
NO_JSON = "No_JSON_Found"
BAD_JSON = "JSON_Parse_Error"
INVALID_LABEL = "Invalid_Label"
UNKNOWN = "Unknown"

# Variant replies.
FLAT_OBJECT = r'(?s)\{[^{}]*"example"[^{}]*"template"[^{}]*\}'
NOT_A_LOG = ["```", "/*", "*/"]
LOG_MIN = 5

# Taxonomy document.
HEADING = "####"
EXAMPLE_HEADS = ["- Example errors:", "- Examples:"]
# A block: heading with letter and title, then its text up to the next heading or the end. The strict text
# holds no "#" at all and is taken in one go; the loose one may hold single ones.
BLOCK_HEAD = r"(?s)#### ([A-Z])\. ([^\n]+)\n- "
BLOCK = {
    "observed": BLOCK_HEAD + r"([^#]++)(?=####|\z)",
    "intended": BLOCK_HEAD + r"([^#]++(?:#(?!###)[^#]*+)*+)",
}
REST_OF_LINE = r"(.*?)(?:\n|\r|$)"
MERGED_HEADER = """# Log Parsing Error Type Analysis (Merged)

Analysis results after similarity-based merging
Similarity threshold: {threshold}

## Data Overview

- Error types merged based on semantic similarity
- Categories with similarity > {threshold} have been consolidated

---

## Error Type Classification

Here are the consolidated error categories:
"""
ANALYSIS_HEADER = """# Log Parsing Error Type Analysis

Analysis results based on {sampled} error summaries
Model used: {model}

## Data Overview

- Data source: {source}
- Total records: {total}
- Valid error summaries: {valid}
- Analysis sample size: {sampled}

---

## Error Type Classification

"""

# Table columns, in sink order.
LOG_COLUMNS = ["Content", "EventTemplate"]
PREDICTION_COLUMNS = ["Content", "Prediction", "Think-Process", "EventTemplate"]
DIFF_COLUMNS = ["Content", "Think-Process", "EventTemplate"]
SUMMARY_COLUMNS = ["original_log", "correct_template", "error_summary"]
LABEL_COLUMNS = ["Original_Log", "Correct_Template", "Error_Type", "Error_Number"]
SEED_COLUMNS = ["Original_Log", "Correct_Template", "error_summary", "Error_Type", "Error_Number"]
TUNING_COLUMNS = ["instruction", "input", "output"]
TUNING_NAMES = {"instruction": "prompt", "input": "query", "output": "response"}

# Words a CSV cell may hold for a missing value.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SEED = 42
SIMILARITY_THRESHOLD = 0.9
VARIANTS_PER_SEED = 7
MAX_TUNING_ROWS = 20000

INSTRUCTION = (
    "Convert the following log into a standardized template by identifying and replacing "
    "the variable parts with a <*>:"
)

# Prompts. Names in braces are filled per row.
PARSE_PROMPT = """You are tasked with analyzing the following log message and explaining your thought process in detail:  

"{log}"  

Please follow these steps:  
1. Examine the log message carefully  
2. Identify which parts are likely to be variables (numbers, IDs, timestamps, etc.)  
3. Replace variable parts with "<*>" symbols  
4. PROVIDE DETAILED STEP-BY-STEP REASONING for your decisions  

When responding:  
1. First explain your thought process thoroughly (why you think certain parts are variables)  
2. Then provide the final template with "<*>" replacing variables  
3. Make sure to include "TEMPLATE:" before your final template  

Please be thorough in your analysis and reasoning.
"""

ERROR_SYSTEM = """  
You are an expert in log parsing analysis. Your task is to analyze how a student model processes log templates and identify errors in their reasoning.  

For each log, I will provide:  
1. Original log: The raw log message  
2. Student's thinking process: How they reasoned about extracting the template  
3. Correct template: The expected template with variables marked as <*>  

Analyze the student's reasoning and identify any errors they made. DO NOT classify the error type.  
Instead, provide a detailed description of what went wrong in the reasoning process (2-3 sentences).  

IMPORTANT: Your output must EXACTLY follow this format with NOTHING ELSE:  
error_summary: A detailed explanation of what went wrong (or what was done correctly) in 2-3 sentences.  
"""
ERROR_USER = (
    "Original log: {log}\nStudent's thinking process: {reasoning}\n"
    "Correct template: {template}\n\nAnalysis:"
)

TAXONOMY_SYSTEM = (
    "You are an expert in log parsing analysis who specializes in categorizing parsing errors "
    "into clear, distinct types based on actual error content."
)
TAXONOMY_USER = """
You are an expert in log parsing analysis. I will provide you with error summaries from failed log parsing attempts.

Your task is to:
1. Analyze the error patterns and naturally group them into distinct error categories
2. For each category, provide a clear name and description
3. Include 2-3 SPECIFIC ERROR TEXT EXAMPLES from the actual data provided
4. Do NOT include frequency analysis, recommendations, or priority rankings
5. Focus ONLY on categorizing and describing the error types

Below are the error summaries from log parsing attempts:

{summaries}

Please provide your analysis in the following format for each error category you identify:

#### [Letter]. [Error Category Name]
- [Brief description of what this error type involves]
- Example errors: [Quote 2-3 actual error text examples from the data above]

IMPORTANT GUIDELINES:
- Group errors naturally
- Focus on the core parsing logic errors, not infrastructure issues
- Provide clear, descriptive category names
- Include ACTUAL ERROR TEXT as examples, not numbers or IDs
- Quote the exact error text from the summaries I provided
- Do NOT include frequency counts, impact analysis, or recommendations
- Only output the error categories and their descriptions with actual text examples

"""

CLASSIFY_SYSTEM = "You are a professional log analysis tool."
CLASSIFY_USER = """You are a log analysis tool. Classify the log parsing error into one of these categories:

{options}

Analyze the following:
Original Log: {log}
Model's Reasoning: {reasoning}
Correct Template: {template}

Output ONLY a JSON with two fields:
- "label": number from 1 to {count}
- "error_type": the category name

Do not include any explanations or additional text."""

AUGMENT_SYSTEM = (
    "You are a professional log augmentation tool that generates semantically meaningful "
    "log variants for training parsing models."
)
AUGMENT_SUBSTITUTE = """
You are a professional log augmentation tool specializing in variable substitution while preserving log semantics.

Given the following information:
- Original Log: The source log message
- Template: The correct template with <*> marking variable parts  
- Error Explanation: Description of why the original parsing failed
- Error Type: The high-level category of the parsing error

Your task is to generate {count} new log variants by:
1. Only replacing parts that correspond to <*> in the template
2. Generating semantically reasonable values for variable parts (numbers, timestamps, IDs, etc.)
3. Keeping all constant parts exactly the same
4. Ensuring the generated logs would still match the same template

The error explanation helps you understand what went wrong in the original parsing, so you can generate similar cases that might face the same parsing challenges.

Output only a JSON array of strings, where each string is a new log variant.
No explanations, just the JSON array.


Original Log: {log}
Template: {template}
Error Explanation: {summary}
Error Type: {type}"""
AUGMENT_REWRITE = """
You are a professional log augmentation tool specializing in constant-inclusive rewriting.

Given the following information:
- Original Log: The source log message
- Template: The original template with <*> marking variable parts
- Error Explanation: Description of why the original parsing failed  
- Error Type: The high-level category of the parsing error

Your task is to generate {count} new log variants by:
1. Modifying constant parts of the log with semantically equivalent expressions
2. Optionally changing variable parts as well
3. Maintaining the overall semantic meaning and log structure
4. Creating variations that preserve the parsing challenge described in the error explanation

Since you're changing constant parts, you must also generate the correct template for each new log.

Output format: JSON array of objects, each containing:
- "example": The new log message
- "template": The correct template for this new log (with <*> for variable parts)

No explanations, just the JSON array.


Original Log: {log}
Template: {template}
Error Explanation: {summary}
Error Type: {type}"""
AUGMENT_SEMANTIC = """
You are a professional log augmentation tool specializing in semantic rewriting to preserve or induce specific parsing errors.

You will perform one of two tasks based on the input:

TASK A - Error-Preserving Rewriting:
When given a log that already triggers a specific error type, generate new logs that would trigger the same type of error.

TASK B - Error-Inducing Rewriting:  
When given any log, rewrite it to trigger a specific target error type.

{document}

Your task is to generate {count} new examples that demonstrate the same error type.

Output format: JSON array of objects, each containing:
- "example": The new log message  
- "template": The template that demonstrates the error type
- "error_type": The error type number (1-{types})

No explanations, just the JSON array.


Original Log: {log}
Template: {template}
Error Explanation: {summary}
Error Type: {type}
Error Number: {number}

Task: Generate new examples that would trigger the same type of parsing error."""

TOPUP_SYSTEM = "You are a professional log augmentation tool."
TOPUP_SUBSTITUTE = """  
Please generate {count} additional variable substitution variants for the following log. 
These must be different from the original log and already generated versions.
Only replace variable parts (<*>), keep constant parts exactly the same.

Original log: {log}  
Template: {template}  
Error Explanation: {summary}
Error Type: {type}

Already generated versions:  
{existing}  

Generate {count} new variants. Return as JSON array of strings only.
"""
TOPUP_REWRITE = """
Please generate {count} additional constant-inclusive rewriting variants.
These must be different from the original and already generated versions.
You can modify both constant and variable parts, and must provide new templates.

Original log: {log}  
Template: {template}  
Error Explanation: {summary}
Error Type: {type}

Already generated versions:  
{existing}  

Generate {count} new variants. Return as JSON array with "example" and "template" fields.
"""
TOPUP_SEMANTIC = """
Please generate {count} additional semantic rewriting variants that trigger similar parsing errors.

{document}

Original log: {log}  
Template: {template}  
Error Explanation: {summary}
Error Type: {type}
Error Number: {number}

Already generated versions:  
{existing}  

Generate {count} new variants. Return as JSON array with "example", "template" and "error_type" fields.
"""
