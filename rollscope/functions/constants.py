"""Fixed values.

Everything in this module must equal the values the scored tasks use:
class lists, prompt text, tolerances and regex patterns.  They are
stated here plainly and in their natural order; the operators take them
as parameters so any task can pass its own.
"""

# --- fixed values: class lists -------------------------------------------
EMOTION_CLASSES = ["anger", "disgust", "fear", "joy", "sadness", "surprise", "neutral"]
EMOTION_CLASSES_COT = ["fear", "sadness", "surprise", "anger", "confusion", "joy", "love"]
IMAGE_CLASSES = [
    "laptop", "mouse", "backpack", "frying pan", "pencil sharpener",
    "digital clock", "paintbrush", "toilet tissue", "remote control", "bottlecap",
]
GENERATOR_CLASSES = [
    "analog clock", "backpack", "ballpoint", "Band Aid", "barbell", "barber chair",
    "beer bottle", "beer glass", "binoculars", "bolo tie", "bookcase", "bottlecap",
    "brassiere", "broom", "bucket", "buckle", "candle", "can opener", "carton",
    "cellular telephone",
]

# --- fixed values: numeric constants --------------------------------------
PROB_EPSILON = 1e-10          # clip floor before renormalising distributions
ADVANTAGE_EPSILON = 1e-4      # added to the group std
LEAK_FACTOR = 0.1             # reward multiplier when a leak is found
ALLCLOSE_RTOL = 1e-3
ALLCLOSE_ATOL = 1e-5
RESCALE_TARGET = (1000, 1000)  # box rescale target (width, height)
DEFAULT_G = 8                 # rollouts per source row

# --- fixed values: regex patterns (Python syntax of the scored tasks) -----
# key/value pair inside a probability answer (loose and strict forms)
KV_PATTERN_LOOSE = r"""(\w+)["']?\s*:\s*(\d+\.?\d*)"""
KV_PATTERN_STRICT = r"""'(\w+)':(\d+\.?\d*)"""
# a decimal number inside reasoning text means the label leaked
NUMBER_LEAK = r"\d+\.\d+"
# reasoning text that is nothing but a coordinate list
COORD_LEAK = r"^\s*[\[\(]\s*(-?\d+\.?\d*)\s*(,\s*(-?\d+\.?\d*)\s*)*[\]\)]\s*$"
# class-answer format: think block, optional whitespace, answer block
FORMAT_TAGS = r"<think>.*?</think>\s*<answer>.*?</answer>"
# referred-box format: answer is exactly one non-negative 4-number list
FORMAT_ONE_BOX = (r"<think>.*?</think>\s*<answer>\[\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*,"
                  r"\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*\]</answer>")
# strict 4-number list (referred box)
STRICT_BOX_GROUPS = (r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
                     r"\s*,\s*(-?\d+(?:\.\d+)?)\s*\]")
# bracket without nested brackets (multi-box answers)
BRACKET = r"\[[^\[\]]+\]"
# numbers inside a bracket when it is not valid JSON
BRACKET_NUMBER = r"[-+]?\d*\.\d+|[-+]?\d+"
# 4-number coordinate run (removed before decimals)
COORD_RUN = r"\[?\s*(-?\d+\.?\d*),\s*(-?\d+\.?\d*),\s*(-?\d+\.?\d*),\s*(-?\d+\.?\d*)\s*\]?"
# decimal numbers
FLOAT_SIMPLE = r"[-+]?\d*\.\d+([eE][-+]?\d+)?"
FLOAT_FULL = r"[+-]?(\d*\.\d+|\d+\.\d*)([eE][+-]?\d+)?|\d+[eE][+-]?\d+"
# sentence enders used by the sentence remover
SENTENCE_ENDERS = "。！？.!?"
# structured target list
TARGET_COUNT = r"Identified\s+(\d+)\s+potential\s+"
TARGET_LINE = r"Target\s*(\d+)\s*:\s*(.+)"

# --- fixed values: prompt text --------------------------------------------
SYSTEM_PROMPT = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
    "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
    "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
    "<think> reasoning process here </think><answer> answer here </answer>"
)

# --- fixed values: dataset and second-stage prompt templates ---------------
# {answer} = one-hot probability string
GENERATOR_QUESTION = (
    "Analyze the image to explain how the visual elements support the object classification probability "
    "distribution {answer}, concisely in under 100 words. Describe key objects, shapes, textures, and contextual "
    "details that contribute to the inferred object category, highlighting their connection to the classification "
    "probabilities. Avoid directly stating the object names or probabilities; instead, focus on the visual cues "
    "and their implications."
)
# P8a emotion: {categories} {description} {slots}
SECOND_STAGE_EMOTION = (
    "Analyze the provided image description and generate a probability distribution across emotion categories. "
    "Categories: {categories}.Description: {description}.Output the final answer in the following format: "
    "{slots},where prob_0, prob_1, ..., prob_5 are probabilities summing to 1."
)
# P8b multi-box: {target} {description}
SECOND_STAGE_MULTIBOX = (
    "The image is of resolution 1000×1000. Based on the following reasoning, which describes the region "
    "corresponding to the target category \"{target}\": {description}, please extract and output the exact "
    "bounding box coordinates of that region.Only return the result in the following format:"
    "[[x1,y1,x2,y2],...,[x1,y1,x2,y2]]."
)
# P8c referred box: {target} {description}
SECOND_STAGE_ONEBOX = (
    "The image is of resolution 1000×1000. Based on the following reasoning, which describes the region "
    "corresponding to the target category \"{target}\": {description}, please extract and output the exact "
    "bounding box coordinates of that region.Only return the result in the following format:[x1, y1, x2, y2]."
)
# P8d category name: {description}
SECOND_STAGE_CATEGORY = (
    "Based on the description: '{description}', provide only the category name of the object in the image. "
    "Do not include any additional text."
)
# P9 region prompt: {box} {contains} {object}
REGION_PROMPT = (
    "Describe why the region is identified as the target object. The region's coordinates are {box}, and it "
    "contains {contains} Analyze its shape, color, texture, and contextual clues. Using these visual and contextual "
    "features, explain why this region is recognized as {object}. Provide a clear Chain-of-Thought (CoT) to "
    "justify the conclusion."
)
LOSS_BETA = 0.04              # KL weight in the token loss (trainer default)
FEWSHOT_K = 4                 # rows per class in the few-shot subset
HEAD_N = 16                   # rows kept by the head-N subset
# P8e emotion with a worked example: {categories} {description} {example}
SECOND_STAGE_EMOTION_EXAMPLE = (
    "Please analyze the provided image description and generate a probability distribution across the following "
    "emotion categories: {categories}. Description: {description}. Do not provide any additional explanations or "
    "reasoning. Only return the result in the specified format. Each probability must be a floating-point number "
    "between 0 and 1, rounded to 6 decimal places. The sum of all probabilities must be exactly 1.000000 (allowing "
    "for minor floating-point errors). Example output: {example}. Incorrect output: {{'anger': 0, 'disgust': 0, "
    "'fear': 0, 'joy': 1.0, 'sadness': 0, 'surprise': 0, 'neutral': 0}}."
)
EXAMPLE_EMOTION_CATEGORIES = "'anger', 'disgust', 'fear', 'joy', 'sadness', 'surprise', 'neutral'"
EXAMPLE_EMOTION_OUTPUT = ("{'anger': 0.0, 'disgust': 0.1666667, 'fear': 0.1, 'joy': 0.466667, 'sadness': 0.1, "
                          "'surprise': 0.166667, 'neutral': 0.0}")
