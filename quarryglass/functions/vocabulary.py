"""Word lists, thresholds and formats of the tagging, naming and search rules."""

# Groups and their members, searched in this order.
SCENE_PARENTS = {
    "outdoor": ("nature", "landscape", "beach", "mountain", "forest", "city", "street", "park", "garden"),
    "indoor": ("home", "office", "restaurant", "store", "gym", "kitchen", "bedroom", "living_room"),
    "event": ("party", "concert", "sports", "wedding", "birthday", "graduation", "ceremony"),
    "subject": ("portrait", "selfie", "group", "pet", "food", "product"),
    "travel": ("landmark", "architecture", "sunset", "sunrise", "skyline", "monument"),
    "vehicle": ("car", "truck", "motorcycle", "bicycle", "airplane", "boat", "train"),
}
OBJECT_GROUPS = {
    "people": ("person", "man", "woman", "child", "baby", "crowd", "face"),
    "vehicles": ("car", "truck", "motorcycle", "bicycle", "bus", "train", "airplane", "boat"),
    "animals": ("dog", "cat", "bird", "horse", "cow", "elephant", "bear", "fish", "sheep"),
    "electronics": ("laptop", "phone", "tv", "computer", "keyboard", "mouse", "monitor"),
    "furniture": ("chair", "couch", "bed", "table", "desk", "bench", "cabinet"),
    "food": ("pizza", "cake", "sandwich", "fruit", "vegetable", "drink", "bottle"),
    "sports": ("ball", "racket", "skateboard", "surfboard", "ski", "snowboard", "bat"),
    "nature": ("tree", "flower", "plant", "grass", "water", "sky", "cloud", "mountain"),
}
COLOR_TONES = {
    "warm": ("red", "orange", "yellow", "brown"),
    "cool": ("blue", "cyan", "teal", "purple"),
    "neutral": ("gray", "white", "black", "beige"),
    "vibrant": ("magenta", "lime", "pink", "turquoise"),
}
# Labels, categories, brands and word parts of the rules.
SCENE_LABELS = ("indoor", "outdoor", "nature", "city", "landscape", "portrait", "food", "animal", "vehicle", "architecture", "beach", "mountain", "forest", "sunset", "night", "party", "sports", "concert", "travel", "selfie")
CATEGORIES = ("scene", "objects", "quality", "color", "temporal", "technical", "format", "people", "location", "mood")
PRIORITY = ("scene", "objects", "quality", "people", "temporal", "location", "color", "mood", "technical", "format")
MAX_TAGS = 30
BRANDS = ("iphone", "samsung", "canon", "nikon", "sony")
URBAN = ("city", "street", "architecture", "building", "skyline")
CHEERFUL, MOODY = ("yellow", "orange", "pink"), ("blue", "purple", "gray")
ROMANTIC, PEACEFUL, ENERGETIC = ("sunset", "sunrise", "beach"), ("nature", "forest", "garden", "park", "landscape"), ("sports", "action", "concert")
PRODUCTS = ("bottle", "can", "box", "package", "container", "bag", "jar", "product")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".m4v", ".webm")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf")
NAME_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "tiff", "bmp", "gif")
INVALID_IN_NAMES = '<>:"/\\|?*'
DATE_FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
# Short names of resolutions, and upper bounds of levels.
RESOLUTION_TERMS = {"4k": "3840", "1080p": "1920", "720p": "720"}
SHARPNESS = ((100, "very_blurry"), (300, "slightly_blurry"), (500, "acceptable"), (1000, "sharp"))
EXPOSURE = ((50, "underexposed"), (85, "slightly_dark"), (170, "well_exposed"), (205, "slightly_bright"))
