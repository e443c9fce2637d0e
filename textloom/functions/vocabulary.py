"""Word lists that results depend on."""

# The topic vocabulary.
TOPIC = """
premier league epl matchweek gameweek fixture fixtures kickoff kick-off
anfield emirates etihad stamford bridge old trafford villa park goodison
arsenal aston villa bournemouth brentford brighton burnley chelsea
crystal palace everton fulham liverpool luton manchester city united
newcastle nottingham forest sheffield tottenham hotspur west ham wolves
wolverhampton leeds leicester southampton ipswich
goal goals assist assists penalty offside var referee lineup lineups
manager transfer signing loan injury suspension clean sheet
standings table relegation champions league europa fa cup carabao
""".split()

# Path segments that are off topic.
OFF_TOPIC = """
rugby cricket nfl nba mlb nhl tennis golf f1 formula1 boxing ufc darts
cycling athletics olympics netball snooker horse-racing racing gaa
la-liga serie-a bundesliga ligue1 ligue-1 mls eredivisie
politics business culture lifestyle travel weather money tv-radio
shop store tickets hospitality careers jobs privacy cookie terms
""".split()

# First host labels of service sites.
SERVICE_HOSTS = """
jobs careers workwithus shop store holidays travel members account
accounts login signin subscribe subscription help support ads cdn
static assets img images mail id auth checkout tickets hospitality
fantasy global africa espndeportes
""".split()

# Suffixes of binary files.
BINARY_SUFFIXES = """
.jpg .jpeg .png .gif .webp .svg .ico .bmp .tiff .mp4 .m4v .mov .avi .webm
.mp3 .m4a .wav .ogg .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .gz .tar
.rar .7z .css .js .json .xml .rss .atom .woff .woff2 .ttf .eot .apk .exe
""".split()

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ["co.uk", "com.au", "co.za", "com.br", "co.jp", "com.mx", "co.nz", "org.uk"]
# Prefixes of tracking parameters.
TRACKING = ["utm_", "gclid", "fbclid", "mc_cid", "mc_eid", "icid", "ito", "cmp"]
# Path parts of fresh content.
FRESH = ["/news", "/report", "/match", "/fixture", "/result", "/transfer", "/live", "/preview", "/analysis", "/interview", "/blog"]
# Elements that hold no main text.
DROPPED_TAGS = ["script", "style", "noscript", "template", "svg", "iframe", "nav", "header", "footer", "aside", "form", "button"]

# English stopwords.
STOPWORDS = """
a about above after again against ain all also am an and any are aren as at be because been before
being below between both but by could couldn d did didn do does doesn doing don down during each few
for from further had hadn has hasn have haven having he her here hers herself him himself his how i
if in into is isn it its itself just l ll m ma me might mightn more most must mustn my myself needn
no nor not now o of off on once only or other our ours ourselves out over own re s same shall shan
she should shouldn so some such t th than that the their theirs them themselves then there these
they this those through to too under until up ve very w was wasn we were weren what when where which
while who whom why with would wouldn y you your yours yourself yourselves
""".split()

# Synonyms, the first word of each line is the canonical one.
SYNONYM_LINES = [
    "football, soccer",
    "goalkeeper, goalie, keeper",
    "referee, ref",
    "fans, supporters",
    "trophy, silverware",
    "win, victory",
]

# Known entities, the first field of each line is the canonical term.
ENTITY_LINES = [
    "premier_league | Premier League | English Premier League | EPL",
    "fa_cup | FA Cup",
    "league_cup | League Cup | Carabao Cup | EFL Cup | Capital One Cup",
    "champions_league | Champions League | UEFA Champions League",
    "europa_league | Europa League | UEFA Europa League",
    "conference_league | Conference League | UEFA Conference League",
    "world_cup | World Cup | FIFA World Cup",
    "manchester_city | Manchester City | Man City",
    "manchester_united | Manchester United | Man United | Man Utd | Manchester Utd",
    "newcastle_united | Newcastle United | Newcastle Utd",
    "aston_villa | Aston Villa",
    "crystal_palace | Crystal Palace",
    "nottingham_forest | Nottingham Forest",
    "hull_city | Hull City",
    "tottenham | Tottenham Hotspur | Spurs",
    "arsenal | Gunners",
    "everton | Toffees",
    "brighton | Brighton and Hove Albion | Brighton & Hove Albion | Brighton Hove Albion",
    "leeds | Leeds United | Leeds Utd",
    "ipswich | Ipswich Town",
    "coventry | Coventry City",
    "bournemouth | AFC Bournemouth",
    "west_ham | West Ham United",
    "wolves | Wolverhampton Wanderers",
    "leicester | Leicester City",
    "sheffield_united | Sheffield United | Sheffield Utd",
    "luton | Luton Town",
]

# Month names and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7,
    "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

#: Lemmas of frequent English words, most of them irregular: the lemma, then its forms.
LEMMA_LINES = """
be been being|begin began begun beginning|break broke broken|bring brought|build built|buy bought|catch caught|child children|choose chose chosen|come came coming
do done|draw drew drawn|drive drove driven|fall fell fallen|feel felt|fight fought|find found|fly flew flown|foot feet|forget forgot forgotten|get got gotten getting
give gave given giving|go went gone going goes|grow grew grown|hear heard|hold held|keep kept|know knew known|lead led|leave left leaving|lose lost losing|make made making
man men|match matches|meet met|pay paid|play played playing plays|run ran running|say said says|score scored scoring scores|see saw seen|sell sold|send sent|show shown
sit sat|speak spoke spoken|spend spent|stand stood|take took taken taking|teach taught|tell told|think thought|throw threw thrown|win won winning|woman women|write wrote written writing
goal goals|team teams|player players|game games|season seasons|club clubs|fan fans|injury injuries|victory victories|penalty penalties
""".replace("\n", "|").strip("|").split("|")
LEMMAS = {form: line.split()[0] for line in LEMMA_LINES for form in line.split()[1:]}
