"""Fixed values that must equal the source application's for equal results.

Everything here is data, stated plainly and in its natural order.
"""

# Thematic tag taxonomy, category -> allowed values (111 in all).
TAG_TAXONOMY = {
    "social_context": [
        "Mainstream Blockbuster", "Award Season Contender", "Legacy Franchise",
        "Family Mainstay", "Regional Cinema", "Direct-to-Streaming",
        "Indie Darling", "Date Night Pick", "Niche/Cult Audience",
        "Cult Classic", "Documentary/Edu-tainment", "Ensemble/Group Watch",
        "Teen/YA Audience", "Holiday/Seasonal", "Documentary Reality",
        "Film Festival Niche", "Girls' Night Pick", "B-Movie/Grindhouse",
        "New Wave/Avant-Garde",
    ],
    "pacing": [
        "Standard Narrative", "Fast-Paced/Punchy", "Slow Burn/Atmospheric",
        "Light/Breezy", "Breakneck/Relentless", "Steady/Procedural",
        "Rising/Crescendo", "Episodic/Non-Linear", "Tight/Economical",
        "Staccato/Erratic", "Meditative/Languid", "Hyper-Active/Frenetic",
        "Fragmented/Chaotic", "Graceful/Flowing", "Meandering/Picaresque",
    ],
    "cognitive_load": [
        "Light/Popcorn", "Moderate/Intellectual", "High/Demanding",
        "Intuitive/Emotional", "Socially Challenging", "Stress-Inducing/Tense",
        "Dense/Philosophical", "Puzzle-Box/Mystery", "Educational/Informative",
        "Complex/Mind-Bender", "Cryptic/Abstract", "Meta/Self-Referential",
        "Symphonic/Visual",
    ],
    "social_value": [
        "High Prestige", "Universal/Classic", "Mainstream Popular",
        "Nostalgia Trip", "Guilty Pleasure", "Water-Cooler Event",
        "Iconic/Legendary", "Niche Interest", "Feel-Good Hit",
        "Hidden Gem", "Cult Favourite", "Safe Crowd-Pleaser",
        "Divisive/Controversial", "Culturally Specific", "Political/Activist",
        "Legacy Franchise", "Trend-Setter", "Ephemeral/Dated",
    ],
    "vibes": [
        "Warm/Nostalgic", "Vibrant/Whimsical", "Grandiose/Epic",
        "Gritty/Raw", "Gritty/Neon", "Naturalistic/Earth-Toned",
        "Uplifting/Inspirational", "Dark/Gothic", "Cerebral/Minimalist",
        "Bleak/Desaturated", "Chaotic/Absurdist", "Intimate/Raw",
        "Surreal/Dreamlike", "Indie/Quirky", "Sleek/Stylish",
        "Nostalgic/Retro", "Pastel/Soft", "Psychedelic/Acid-Trip",
        "Abrasive/Industrial", "Technicolor/Vintage", "Symphonic/Visual",
    ],
    "narrative_resolve": [
        "Feel-Good/Triumphant", "Ambiguous/Open-Ended", "Hopeful/Redemptive",
        "Bittersweet/Poignant", "Cynical/Grim", "Tragic/Devastating",
        "Justice-Oriented", "Clean Resolution", "Ongoing/No Resolution",
        "Cathartic Release", "Absurdist/Satirical", "Cliffhanger",
    ],
    "tension_profile": [
        "Escalating Tension", "Low-Stakes/Gentle", "Simmering/Understated",
        "Sustained Tension", "Psychological/Creeping", "No Real Tension",
        "Explosive/Visceral", "Intermittent/Burst", "High-Stakes/Urgent",
        "Comic Tension", "Campy/Performative", "Constant/Anxiety-Inducing",
        "Intellectual/Competitive",
    ],
}

# Content rating -> bucket; anything else is "NR".
RATED_BUCKETS = {
    "R": "R", "TV-MA": "R", "18+": "R",
    "PG-13": "PG13", "TV-14": "PG13", "16+": "PG13",
    "PG": "PG", "TV-PG": "PG",
    "G": "G", "TV-G": "G",
}
RATED_ONE_HOT = ["G", "PG", "PG13", "R", "NR"]

# Parents-guide severity ordinal; unknown is -1 (detail view 0).
SEVERITY_ORDINAL = {"None": 0, "Mild": 1, "Moderate": 2, "Severe": 3}
GUIDE_COLUMNS = ["sex_nudity", "violence_gore", "profanity", "alcohol_drugs", "intensity"]

# Decade one-hot columns (before 1970 and from 2020 are open-ended).
DECADE_COLUMNS = ["decade_pre1970s", "decade_1970s", "decade_1980s", "decade_1990s",
                  "decade_2000s", "decade_2010s", "decade_2020s"]

# Primary language and country flags.
LANGUAGE_COLUMNS = ["lang_english", "lang_hindi", "lang_other"]
COUNTRY_NAMES = {"country_us": "united states", "country_uk": "united kingdom",
                 "country_india": "india"}

# Closest-match blend weights and defaults.
SIM_WEIGHTS_WITH_TAGS = (0.60, 0.30, 0.10)   # cosine, tag Jaccard, score proximity
SIM_WEIGHTS_NO_TAGS = (0.85, 0.15)           # cosine, score proximity
SIM_DEFAULT_SCORE = 5.0
SIM_DISPLAY_CEIL = 0.65
PAIR_MATCH_THRESHOLD = 0.52

# Confidence bands of the card (>=90, >=80, >=70, else) and the
# verdict scale of the desktop view (>=90, >=70, >=50, else).
CONFIDENCE_BANDS = [(90, "Top Pick"), (80, "Strong Contender"), (70, "Likely Enjoy")]
CONFIDENCE_DEFAULT = "Mixed Signals"
VERDICT_BANDS = [(90, "Must Watch"), (70, "Strong Contender"), (50, "Coin Toss")]
VERDICT_DEFAULT = "Probably Not For You"

# Stratified hold-out rating bins (right-closed) and share.
RATING_BINS = [0, 3, 5, 7, 8, 10]
HOLDOUT_SHARE = 0.2
SPLIT_SEED = 42

# Boosted-tree settings of the per-person model.
GBT_PARAMS = {"maxIter": 500, "stepSize": 0.03, "maxDepth": 5,
              "minInstancesPerNode": 12, "seed": 42}
L2_REGULARIZATION = 0.5

# champion/challenger promotion margin.
PROMOTION_MARGIN = 0.005

# Human-readable labels of model features.
FEATURE_LABELS = {
    "imdbRating": "IMDb Rating",
    "imdbVotes": "IMDb Popularity",
    "Metascore": "Metacritic Score",
    "RT_score": "RT Critic",
    "BoxOffice": "Box Office",
    "Runtime": "Runtime",
    "award_wins": "Awards Won",
    "award_noms": "Award Nominations",
    "oscar_win": "Oscar Winner",
    "oscar_nom": "Oscar Nominated",
    "decade_pre1970s": "Pre-1970s Film",
    "decade_1970s": "1970s Film",
    "decade_1980s": "1980s Film",
    "decade_1990s": "1990s Film",
    "decade_2000s": "2000s Film",
    "decade_2010s": "2010s Film",
    "decade_2020s": "2020s Film",
    "rated_G": "Rated G",
    "rated_PG": "Rated PG",
    "rated_PG13": "Rated PG-13",
    "rated_R": "Rated R",
    "rated_NR": "Not Rated",
    "lang_english": "English Language",
    "lang_hindi": "Hindi Language",
    "lang_other": "Foreign Language",
    "country_us": "US Production",
    "country_uk": "UK Production",
    "country_india": "Indian Production",
    "country_other": "International Production",
    "director_film_count": "Director: Films Seen",
    "director_avg_rating": "Director: Avg Rating",
    "actor1_film_count": "Actor: Films Seen",
    "actor1_avg_rating": "Actor: Avg Rating",
    "studio_film_count": "Studio: Films Seen",
    "studio_avg_rating": "Studio: Avg Rating",
    "pg_sex_nudity": "PG: Sex & Nudity",
    "pg_violence_gore": "PG: Violence & Gore",
    "pg_profanity": "PG: Profanity",
    "pg_alcohol_drugs": "PG: Alcohol & Drugs",
    "pg_intensity": "PG: Intensity",
}

# One-hot feature prefixes (shown only when the value is 1).
ONE_HOT_PREFIXES = ["genre_", "tag_", "decade_", "rated_", "lang_", "country_"]
MAX_DRIVERS = 8
TOP_SIGNED = 4
