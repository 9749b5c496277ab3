"""Reference lists.  Every operator takes its lists as parameters; these are the defaults.

The block-list of host suffixes is the user's own table: it has no default beyond social hosts and
directories.
"""

from __future__ import annotations

# Word lists, lookup tables and constants that outputs depend on.
TARGET_TITLES = [
    "ceo", "chief executive", "coo", "chief operating officer", "cto", "chief technology officer", "founder", "co-founder", "cofounder", "owner", "co-owner",
    "managing director", "managing partner", "executive director", "president", "general manager",
    "head of localization", "head of localisation", "head of translation", "head of language", "head of languages",
    "director of localization", "localization director", "director of translation", "translation director", "director of language", "language director",
    "vp of localization", "vp of translation", "vice president of localization", "vice president of translation",
    "localization manager", "localisation manager", "translation manager", "language manager", "language services manager",
    "vendor manager", "vendor coordinator", "localization vendor manager", "translation vendor manager",
    "project manager", "localization project manager", "translation project manager", "localization coordinator",
    "localization operations manager", "language operations manager",
    "localization lead", "localisation lead", "localization engineer", "localization specialist", "localisation specialist",
    "translation specialist", "language specialist", "terminology manager",
]
KEPT_ROLES = ["project manager", "vendor manager", "translation manager"]
FREE_EMAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "icloud.com", "protonmail.com", "aol.com", "126.com", "163.com", "qq.com", "sina.com",
    "yandex.com", "mail.ru", "gmx.com", "gmx.de", "web.de",
]
INDUSTRY_KEYWORDS = {
    "translation": ["translation", "localization", "localisation", "language", "interpreter", "linguist", "multilingual", "translat", "翻译", "traduct", "übersetzung", "subtitl", "dubbing", "lsp", "language service", "certified translat", "sworn translat", "transcription", "interpreting", "ترجمة", "تعريب", "توطين", "مترجم", "ترجمة معتمدة", "خدمات ترجمة"],
    "localization": ["localization", "localisation", "translation", "language", "l10n", "i18n", "internationalization", "globaliz", "linguistic", "multilingual", "translat", "lsp", "language service", "interpreting", "subtitl", "ترجمة", "تعريب", "توطين", "مترجم", "ترجمة معتمدة", "خدمات ترجمة"],
    "marketing": ["marketing", "advertising agency", "branding agency", "campaign", "digital agency", "digital marketing", "creative agency", "communications agency", "media agency", "pr agency", "content agency", "seo agency", "social media agency", "marketing strategy", "marketing firm", "marketing company", "publicis", "wpp", "ogilvy", "integrated marketing", "performance marketing", "growth marketing"],
    "gaming": ["game", "gaming", "studio", "developer", "publisher", "esport", "interactive", "video game", "mobile game", "indie", "playstation", "xbox", "nintendo", "pc game"],
    "medical": ["medical", "pharma", "pharmaceutical", "healthcare", "clinical", "biotech", "hospital", "health", "life science", "diagnostic", "therapeutic", "medtech", "bioscience"],
    "legal": ["legal", "law", "attorney", "lawyer", "barrister", "solicitor", "counsel", "litigation", "firm", "legal service", "juridical"],
    "e-commerce": ["ecommerce", "e-commerce", "online store", "retail", "shop", "marketplace", "shopping", "commerce", "merchant", "dropship", "fulfilment"],
    "financial": ["financial", "finance", "banking", "investment", "insurance", "fintech", "wealth", "asset management", "accounting", "audit", "tax", "fund"],
    "software": ["software", "saas", "tech", "technology", "app", "platform", "cloud", "developer", "digital", "data", "api", "enterprise", "it service"],
    "subtitling": ["subtitle", "subtitling", "dubbing", "caption", "captioning", "media", "post-production", "broadcast", "streaming", "localiz", "translat", "audio description", "accessibility"],
    "education": ["education", "learning", "training", "university", "school", "academy", "e-learning", "edtech", "course", "curriculum", "tutoring"],
}
RELEVANCE_KEYWORDS = [
    "translation", "localization", "localisation", "language service", "interpretation", "interpreter", "linguist", "multilingual", "übersetzung", "traduction", "traduccion", "tradução",
    "vertaling", "tłumaczenie", "翻译", "tercüme", "перевод", "lsp", "language provider", "certified translation", "sworn translation", "subtitling", "dubbing", "localize", "localise", "l10n",
]
AMBIGUOUS_TERMS = ["localization", "localisation", "localize", "localise", "l10n", "i18n", "internationalization", "globaliz", "language"]
STRONG_MARKERS = [
    "translation", "translat", "traduct", "übersetzung", "tercüme", "ترجمة", "تعريب", "توطين", "مترجم", "language service", "lsp", "linguist", "interpreter", "interpreting",
    "subtitl", "dubbing", "sworn", "certified translat", "multilingual", "linguistic", "transcription",
]
LSP_KEYWORDS = [
    "translation agency", "language service", "language services", "localization company", "localisation company", "translation services", "translation company", "interpretation services",
    "language solutions", "we translate", "our translators", "translation provider", "lsp", "transcreation", "post-editing", "post editing", "cat tool", "sdl", "memoq", "trados",
    "translation memory", "language service provider",
]
TLD_COUNTRY = {
    ".co.uk": "United Kingdom", ".org.uk": "United Kingdom", ".uk": "United Kingdom", ".de": "Germany", ".fr": "France", ".es": "Spain", ".it": "Italy", ".nl": "Netherlands", ".pl": "Poland",
    ".se": "Sweden", ".no": "Norway", ".dk": "Denmark", ".fi": "Finland", ".pt": "Portugal", ".be": "Belgium", ".ch": "Switzerland", ".at": "Austria", ".ro": "Romania", ".hu": "Hungary",
    ".cz": "Czech Republic", ".sk": "Slovakia", ".hr": "Croatia", ".bg": "Bulgaria", ".gr": "Greece", ".ru": "Russia", ".ua": "Ukraine", ".co.in": "India", ".in": "India", ".jp": "Japan",
    ".co.jp": "Japan", ".cn": "China", ".com.au": "Australia", ".net.au": "Australia", ".au": "Australia", ".ca": "Canada", ".com.br": "Brazil", ".mx": "Mexico", ".co.za": "South Africa",
    ".za": "South Africa", ".ae": "UAE", ".sa": "Saudi Arabia", ".com.sa": "Saudi Arabia", ".tr": "Turkey", ".com.tr": "Turkey", ".eg": "Egypt", ".il": "Israel", ".co.il": "Israel",
    ".ng": "Nigeria", ".ke": "Kenya", ".ar": "Argentina", ".com.ar": "Argentina", ".cl": "Chile", ".kr": "South Korea", ".co.kr": "South Korea", ".sg": "Singapore", ".com.sg": "Singapore",
    ".my": "Malaysia", ".ph": "Philippines", ".nz": "New Zealand", ".ie": "Ireland",
}
#: country: (dialling code, name forms, cities); a user's table of the same shape adds others.
COUNTRY_GEO = {
    "Argentina": ("+54", ["argentina", "argentine", "argentinian"], ["buenos aires", "córdoba", "cordoba", "rosario"]),
    "Australia": ("+61", ["australia", "australian"], ["sydney", "melbourne", "brisbane", "perth", "canberra"]),
    "Austria": ("+43", ["austria", "austrian", "österreich"], ["vienna", "wien", "graz", "linz", "salzburg"]),
    "Belgium": ("+32", ["belgium", "belgian", "belgië", "belgique"], ["brussels", "bruxelles", "antwerp", "antwerpen", "ghent", "gent"]),
    "Brazil": ("+55", ["brazil", "brazilian", "brasil"], ["são paulo", "sao paulo", "rio de janeiro", "brasília", "brasilia"]),
    "Canada": ("+1", ["canada", "canadian"], ["toronto", "vancouver", "montreal", "montréal", "ottawa", "calgary"]),
    "Chile": ("+56", ["chile", "chilean"], ["santiago", "valparaíso", "valparaiso", "concepción", "concepcion"]),
    "China": ("+86", ["china", "chinese"], ["shanghai", "beijing", "shenzhen", "guangzhou"]),
    "Colombia": ("+57", ["colombia", "colombian"], ["bogotá", "bogota", "medellín", "medellin", "cali"]),
    "Czech Republic": ("+420", ["czech", "czechia", "česká"], ["prague", "praha", "brno", "ostrava"]),
    "Denmark": ("+45", ["denmark", "danish", "danmark"], ["copenhagen", "københavn", "kobenhavn", "aarhus", "odense"]),
    "Egypt": ("+20", ["egypt", "egyptian"], ["cairo", "alexandria", "giza", "nasr city", "maadi", "heliopolis", "new cairo", "6th of october", "zamalek", "mansoura"]),
    "Finland": ("+358", ["finland", "finnish", "suomi"], ["helsinki", "espoo", "tampere", "vantaa"]),
    "France": ("+33", ["france", "french", "française", "francaise"], ["paris", "lyon", "marseille", "toulouse", "lille"]),
    "Germany": ("+49", ["germany", "german", "deutschland"], ["berlin", "munich", "münchen", "munchen", "hamburg", "frankfurt", "cologne", "köln"]),
    "Greece": ("+30", ["greece", "greek", "ελλάδα"], ["athens", "thessaloniki", "patras", "piraeus"]),
    "Hungary": ("+36", ["hungary", "hungarian", "magyarország"], ["budapest", "debrecen", "szeged"]),
    "India": ("+91", ["india", "indian"], ["mumbai", "delhi", "new delhi", "bangalore", "bengaluru", "hyderabad", "chennai", "pune", "noida", "gurgaon", "gurugram"]),
    "Indonesia": ("+62", ["indonesia", "indonesian"], ["jakarta", "surabaya", "bandung", "medan"]),
    "Ireland": ("+353", ["ireland", "irish", "éire"], ["dublin", "cork", "galway", "limerick"]),
    "Israel": ("+972", ["israel", "israeli"], ["tel aviv", "jerusalem", "haifa", "herzliya"]),
    "Italy": ("+39", ["italy", "italian", "italia"], ["milan", "milano", "rome", "roma", "turin", "torino", "naples", "napoli"]),
    "Japan": ("+81", ["japan", "japanese"], ["tokyo", "osaka", "yokohama", "nagoya", "kyoto"]),
    "Kenya": ("+254", ["kenya", "kenyan"], ["nairobi", "mombasa", "kisumu"]),
    "Malaysia": ("+60", ["malaysia", "malaysian"], ["kuala lumpur", "george town", "johor bahru", "petaling jaya"]),
    "Mexico": ("+52", ["mexico", "mexican", "méxico"], ["mexico city", "ciudad de méxico", "guadalajara", "monterrey"]),
    "Netherlands": ("+31", ["netherlands", "dutch", "holland", "nederland"], ["amsterdam", "rotterdam", "the hague", "den haag", "utrecht", "eindhoven"]),
    "New Zealand": ("+64", ["new zealand"], ["auckland", "wellington", "christchurch"]),
    "Nigeria": ("+234", ["nigeria", "nigerian"], ["lagos", "abuja", "kano", "ibadan"]),
    "Norway": ("+47", ["norway", "norwegian", "norge"], ["oslo", "bergen", "trondheim", "stavanger"]),
    "Pakistan": ("+92", ["pakistan", "pakistani"], ["karachi", "lahore", "islamabad", "rawalpindi"]),
    "Peru": ("+51", ["peru", "peruvian", "perú"], ["lima", "arequipa", "trujillo"]),
    "Philippines": ("+63", ["philippines", "filipino", "philippine"], ["manila", "quezon city", "cebu", "makati", "taguig"]),
    "Poland": ("+48", ["poland", "polish", "polska"], ["warsaw", "warszawa", "kraków", "krakow", "wrocław", "wroclaw", "gdańsk", "gdansk"]),
    "Portugal": ("+351", ["portugal", "portuguese"], ["lisbon", "lisboa", "porto", "braga"]),
    "Romania": ("+40", ["romania", "romanian", "românia"], ["bucharest", "bucurești", "bucuresti", "cluj-napoca", "cluj", "timișoara", "timisoara"]),
    "Russia": ("+7", ["russia", "russian"], ["moscow", "saint petersburg", "st petersburg", "novosibirsk"]),
    "Saudi Arabia": ("+966", ["saudi arabia", "saudi", "ksa"], ["riyadh", "jeddah", "dammam", "mecca", "medina", "khobar"]),
    "Singapore": ("+65", ["singapore", "singaporean"], ["singapore"]),
    "South Africa": ("+27", ["south africa", "south african"], ["johannesburg", "cape town", "durban", "pretoria"]),
    "South Korea": ("+82", ["south korea", "korea", "korean"], ["seoul", "busan", "incheon", "daegu"]),
    "Spain": ("+34", ["spain", "spanish", "españa", "espana"], ["madrid", "barcelona", "valencia", "seville", "sevilla", "málaga", "malaga"]),
    "Sweden": ("+46", ["sweden", "swedish", "sverige"], ["stockholm", "gothenburg", "göteborg", "goteborg", "malmö", "malmo"]),
    "Switzerland": ("+41", ["switzerland", "swiss", "schweiz", "suisse"], ["zurich", "zürich", "geneva", "genève", "geneve", "basel", "bern", "lausanne"]),
    "Thailand": ("+66", ["thailand", "thai"], ["bangkok", "chiang mai", "phuket", "nonthaburi"]),
    "Turkey": ("+90", ["turkey", "turkish", "türkiye", "turkiye"], ["istanbul", "ankara", "izmir", "bursa", "antalya"]),
    "UAE": ("+971", ["united arab emirates", "emirati", "emirates", "uae"], ["dubai", "abu dhabi", "sharjah", "ajman"]),
    "Ukraine": ("+380", ["ukraine", "ukrainian"], ["kyiv", "kiev", "kharkiv", "odesa", "odessa", "lviv", "dnipro"]),
    "United Kingdom": ("+44", ["united kingdom", "britain", "british", "england", "scotland", "wales"], ["london", "manchester", "birmingham", "leeds", "glasgow", "edinburgh", "bristol", "liverpool"]),
    "United States": ("+1", ["united states", "u.s.a", "america", "american"], ["new york", "los angeles", "chicago", "houston", "san francisco", "boston", "seattle", "atlanta", "miami", "washington"]),
}
SERP_COUNTRY_EXTRA = {"Egypt": ["مصر", "القاهرة", "الإسكندرية", "الجيزة"]}
HQ_PREFIXES = ["based in ", "headquartered in ", "located in ", "offices in "]
CONTACT_HINTS = ["/contact", "/kontakt", "/impressum", "/nous-ecrire", "/contattaci", "/contato", "/contacto", "/contact-us"]
ABOUT_HINTS = ["/about", "/team", "/uber-uns", "/a-propos", "/chi-siamo", "/sobre", "/our-team", "/company", "/about-us"]
PATH_HINTS = [
    "/about", "/about-us", "/company", "/services", "/solutions", "/contact", "/contact-us", "/team", "/our-team", "/translation", "/localization", "/localisation", "/languages",
    "/interpreting", "/capabilities", "/what-we-do",
]
TEAM_PATHS = ["/team", "/our-team", "/meet-the-team", "/staff", "/our-staff", "/people", "/about", "/about-us", "/about/team", "/management", "/leadership", "/company/team", "/contact", "/contact-us"]
CONTACT_PATHS = [
    "/contact", "/contact-us", "/contact_us", "/contactus", "/about", "/about-us", "/about_us", "/team", "/our-team", "/meet-the-team", "/staff", "/people", "/leadership", "/who-we-are",
    "/management", "/directors", "/founders", "/executives", "/our-people",
]
POSITIVE_TERMS = [
    "localization", "localisation", "translation", "translating", "translator", "interpreting", "interpreter", "language service", "language services", "globalization", "globalisation",
    "subtitling", "dubbing", "transcreation", "lsp", "multilingual", "linguist",
]
PURE_JUNK = ["casino", "betting", "porn", "xxx", "crypto exchange", "forex broker", "dating", "escort"]
JUNK_TITLES = ["login", "sign in", "sign up", "create account", "forgot password", "404", "page not found", "access denied", "403 forbidden", "privacy policy", "terms of service", "cookie policy"]
LISTICLE = ["top 10", "top 20", "top 50", "best 10", "best 20", "best companies", "list of ", "directory of", "companies list", "agency list", "top agencies", "top firms"]
PARKING_SIGNALS = [
    "buy this domain", "this domain is for sale", "domain for sale", "domain is available for purchase", "parked by", "parked free", "domain parking", "godaddy.com/forsale", "sedo.com",
    "coming soon", "under construction", "this site is under construction", "launching soon", "website coming soon",
]
ASSET_EXTENSIONS = [".css", ".js", ".mjs", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".mp4", ".mp3", ".xml", ".json"]
SEO_WORDS = [
    "iso", "certified", "certifications", "accredited", "sworn", "official", "authorized", "agency", "services", "solutions", "provider", "bureau", "professional", "expert", "experts", "global",
    "international", "worldwide", "group", "translations", "translation", "localization", "localisation", "language", "multilingual", "company", "consultancy",
]
SOCIAL_HOSTS = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com"]
JUNK_SUBDOMAINS = [
    "blog.", "news.", "press.", "media.", "jobs.", "careers.", "shop.", "store.", "support.", "help.", "community.", "forum.", "developers.", "dev.", "docs.", "status.", "ir.", "investors.",
    "login.", "signin.", "signup.", "register.", "account.", "accounts.", "auth.", "sso.", "portal.", "dashboard.", "app.", "finance.", "obs-settings.", "settings.", "ayuda.", "cdn.",
]
JUNK_NAME_FRAGMENTS = [
    "zoominfo", "crunchbase", "pitchbook", "statista", "ibisworld", "grandviewresearch", "mordorintelligence", "marketsandmarkets", "alliedmarketresearch", "sphericalinsights",
    "precedenceresearch", "valuatesreports", "reportsanddata", "businessresearchinsights", "expertmarketresearch", "imarcgroup", "fortunebusinessinsights", "coherentmarketinsights",
    "databridgemarketresearch", "researchandmarkets", "superbcompanies", "companiesmarket", "companydata", "techbehemoths", "digitalagencynetwork", "agencyspotter", "agencyanalytics",
]
DIRECTORY_HOSTS = [
    "clutch.co", "goodfirms.co", "goodfirms.io", "lusha.com", "sortlist.com", "expertise.com", "themanifest.com", "designrush.com", "upcity.com", "g2.com", "capterra.com",
    "softwareadvice.com", "bark.com", "manifest.com", "trustpilot.com", "hotfrog.com", "brownbook.net", "cylex.us", "europages.com", "kompass.com",
    "proz.com", "translationcafe.com", "translatorscafe.com", "translationdirectory.com", "gala-global.org", "atanet.org", "ata-divisions.org", "translatorswithoutborders.org", "twb.ngo",
]
DIRECTORY_TITLES = [
    "top 10", "top 20", "top 50", "top translation", "top localization", "best 10", "best 20", "best companies", "best translation", "list of ", "directory of", "companies list", "agency list",
    "top agencies", "top firms", "rankings", "reviews", "blue board", "member directory", "company directory", "find a translator",
]
GENERIC_PREFIXES = [
    "info", "hello", "hola", "hi", "hey", "greetings", "team", "contact", "contactus", "contact-us", "contacts", "support", "help", "helpdesk", "service", "services", "sales", "marketing",
    "business", "commercial", "admin", "administration", "office", "mail", "mailbox", "enquiries", "enquiry", "queries", "query", "questions", "general", "reception", "welcome", "connect",
    "noreply", "no-reply", "donotreply", "do-not-reply", "billing", "accounts", "finance", "accounting", "invoice", "hr", "humanresources", "careers", "jobs", "recruitment", "hiring", "press",
    "media", "pr", "news", "newsletter", "updates", "legal", "privacy", "compliance", "abuse", "security", "webmaster", "postmaster", "it", "tech", "translations", "translation", "translate",
    "translators", "translator", "localization", "localisation", "crisis", "emergency", "urgent", "projects", "project", "pm", "operations", "quotes", "quote", "request", "rfq", "feedback",
    "complaints", "complaint", "invoices", "purchase", "orders", "order", "payment", "payments", "newbusiness", "new-business", "new_business", "biz", "bizdev", "partnerships", "partnership",
    "apply", "vendor", "vendors", "solutions", "solution", "global",
]
NOT_NAME_WORDS = [
    "our", "the", "your", "with", "from", "about", "contact", "more", "read", "learn", "view", "here", "this", "that", "all", "any", "some", "and", "or", "for", "but", "not", "you", "we",
    "they", "us", "my", "me", "him", "her", "them", "translation", "localization", "localisation", "language", "services", "solutions", "company", "agency", "team", "staff", "group",
    "global", "international", "management", "leadership", "meet", "welcome", "hello", "join", "get", "privacy", "policy", "policies", "cookie", "cookies", "consent", "settings", "accept",
    "decline", "close", "preferences", "strictly", "necessary", "compliance", "sandbox", "gdpr", "ccpa", "analytics", "tracking", "free", "quote", "request", "speak", "click", "submit",
    "expand", "networking", "reach", "explore", "discover", "now", "today", "soon", "subtitling", "voiceover", "dubbing", "transcription", "interpretation", "interpretations", "interpreting",
    "trade", "markets", "market", "authority", "budgets", "budget", "media", "paid", "deepen", "talentos",
]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "mba", "ma", "ba", "msc"]
EMAIL_PATTERNS = ["first.last", "f.last", "first.l", "first_last", "firstlast", "flast", "last.first", "lastfirst", "last_first", "last", "first"]
EMAIL_TOKENS = ["{first}.{last}", "{f}.{last}", "{first}.{l}", "{first}_{last}", "{first}{last}", "{f}{last}", "{last}.{first}", "{last}{first}", "{last}_{first}", "{last}", "{first}"]
MAJOR_CITIES = {
    "Argentina": ["Buenos Aires", "Córdoba", "Rosario"], "Australia": ["Sydney", "Melbourne", "Brisbane"], "Austria": ["Vienna", "Graz", "Linz"], "Belgium": ["Brussels", "Antwerp", "Ghent"],
    "Brazil": ["São Paulo", "Rio de Janeiro", "Brasília"], "Canada": ["Toronto", "Vancouver", "Montreal"], "Chile": ["Santiago", "Valparaíso", "Concepción"], "China": ["Shanghai", "Beijing", "Shenzhen"],
    "Colombia": ["Bogotá", "Medellín", "Cali"], "Czech Republic": ["Prague", "Brno", "Ostrava"], "Denmark": ["Copenhagen", "Aarhus", "Odense"], "Egypt": ["Cairo", "Alexandria", "Giza"],
    "Finland": ["Helsinki", "Espoo", "Tampere"], "France": ["Paris", "Lyon", "Marseille"], "Germany": ["Berlin", "Munich", "Hamburg"], "Greece": ["Athens", "Thessaloniki", "Patras"],
    "Hungary": ["Budapest", "Debrecen", "Szeged"], "India": ["Mumbai", "Delhi", "Bangalore"], "Indonesia": ["Jakarta", "Surabaya", "Bandung"], "Ireland": ["Dublin", "Cork", "Galway"],
    "Israel": ["Tel Aviv", "Jerusalem", "Haifa"], "Italy": ["Milan", "Rome", "Turin"], "Japan": ["Tokyo", "Osaka", "Yokohama"], "Kenya": ["Nairobi", "Mombasa", "Kisumu"],
    "Malaysia": ["Kuala Lumpur", "George Town", "Johor Bahru"], "Mexico": ["Mexico City", "Guadalajara", "Monterrey"], "Netherlands": ["Amsterdam", "Rotterdam", "The Hague"],
    "New Zealand": ["Auckland", "Wellington", "Christchurch"], "Nigeria": ["Lagos", "Abuja", "Kano"], "Norway": ["Oslo", "Bergen", "Trondheim"], "Pakistan": ["Karachi", "Lahore", "Islamabad"],
    "Peru": ["Lima", "Arequipa", "Trujillo"], "Philippines": ["Manila", "Quezon City", "Cebu City"], "Poland": ["Warsaw", "Kraków", "Wrocław"], "Portugal": ["Lisbon", "Porto", "Braga"],
    "Romania": ["Bucharest", "Cluj-Napoca", "Timișoara"], "Russia": ["Moscow", "Saint Petersburg", "Novosibirsk"], "Saudi Arabia": ["Riyadh", "Jeddah", "Dammam"], "Singapore": ["Singapore"],
    "South Africa": ["Johannesburg", "Cape Town", "Durban"], "South Korea": ["Seoul", "Busan", "Incheon"], "Spain": ["Madrid", "Barcelona", "Valencia"], "Sweden": ["Stockholm", "Gothenburg", "Malmö"],
    "Switzerland": ["Zurich", "Geneva", "Basel"], "Thailand": ["Bangkok", "Chiang Mai", "Phuket"], "Turkey": ["Istanbul", "Ankara", "Izmir"], "UAE": ["Dubai", "Abu Dhabi", "Sharjah"],
    "Ukraine": ["Kyiv", "Kharkiv", "Odesa"], "United Kingdom": ["London", "Manchester", "Birmingham"], "United States": ["New York", "Los Angeles", "Chicago"],
}
#: search-term templates: {i} industry, {c} country, {g} the country after a space or nothing, {t} city
LANGUAGE_INDUSTRIES = ["localization", "translation", "subtitling"]
COUNTRY_TERMS = [
    "{i} companies in {c}", "{i} agency in {c}", "{i} services {c}", "{i} firm {c}", "best {i} companies {c}", "{i} service providers in {c}", '"{i}" "{c}" -linkedin.com -facebook.com', "{i} company contact {c}",
]
LANGUAGE_COUNTRY_TERMS = ["translation agency {c}", "language services company {c}", "LSP translation {c}", "translation office {c}"]
EGYPT_OFFICE_TERM = "ترجمة شركة {c}"
CITY_TERMS = ["{i} companies in {t}", "{i} agency {t}", "{i} services {t}", "{i} business {t}"]
LANGUAGE_CITY_TERM = "translation agency {t}"
COUNTRY_ONLY_TERMS = ["companies in {c}", "organizations in {c}"]
DIRECTORY_TERMS = [
    "site:clutch.co {i}{g}", "site:goodfirms.co {i}{g}", "site:goodfirms.io {i}{g}", "top {i} companies{g} clutch", "top {i} companies{g} goodfirms", "{i} companies directory{g}", "list of {i} companies{g}",
]
TRADE_INDUSTRIES = ["localization", "translation", "subtitling", "media"]
TRADE_TERMS = [
    "site:proz.com translation company{g}", "site:proz.com blueboard{g}", "site:proz.com companies{g}", "proz.com blue board{g}", "site:translationdirectory.com{g}", "site:translatorscafe.com{g}",
    "site:translationcafe.com{g}", "translation agencies directory{g}", "localization companies directory{g}", "language service providers directory{g}", "LSP directory{g}",
    "site:gala-global.org members{g}", "site:atanet.org directory{g}",
]
TRADE_COUNTRY_TERMS = ["proz.com {c} translation company", "translationdirectory.com {c}", "translatorscafe.com {c} agency"]
EXPANSION_ROLES = ["bureau", "office", "studio", "vendor", "provider", "partner", "consultancy", "firm", "company"]
EXPANSION_CITY_TERMS = ["translation company {t}", "language services {t}", "localization agency {t}", "مكتب ترجمة {t}", "شركة ترجمة {t}"]
EGYPT_EXPANSION_TERMS = [
    "site:.eg translation agency", "site:.eg localization company", "site:.eg language services", "Egyptian translation services company", "certified translation office Egypt",
    "document translation Egypt company", "interpretation company Egypt", "localization services Cairo Egypt contact", "translation company Alexandria Egypt", "translation company Giza Egypt",
    "LSP Egypt contact", "language service provider Egypt email",
]
ROTATION_NICHES = [
    "subtitling", "interpretation", "interpreting", "transcreation", "website localization", "software localization", "DTP translation", "legal translation", "medical translation",
    "certified translation", "audiovisual translation", "game localization",
]
ROTATION_TERMS = ["{i} companies directory {c}", "list of {i} companies {c}", "top {i} agencies {c}", "{i} vendors {c}", "outsourced {i} {c}"]
ROTATION_CITY_TERMS = ["{i} near {t}", "best translation office {t}", "language service provider {t}"]
EGYPT_ROTATION_TERMS = [
    "شركات ترجمة معتمدة مصر", "مكتب ترجمة معتمدة القاهرة", "خدمات الترجمة الفورية مصر", "تعريب مواقع مصر", "site:.eg مكتب ترجمة", "site:.eg ترجمة معتمدة", "translators Egypt company website",
    "localization Egypt LinkedIn company",
]
ROTATION_TLDS = {"Egypt": ".eg", "Saudi Arabia": ".sa", "UAE": ".ae", "United Arab Emirates": ".ae", "Germany": ".de", "France": ".fr", "United Kingdom": ".uk"}
ROTATION_TLD_TERMS = ["site:{d} {i}", "site:{d} translation agency", "site:{d} language services"]
LIST_SIGNALS = ["top ", "best ", "list of", "directory", "rankings", "companies in", "agencies in", "firms in", "companies list", "agency list"]
LIST_TITLES = ["companies in", "agencies in", "firms in", "list of ", "directory of"]
CALL_TO_ACTION = r"(?i)^(visit(\s+website)?|website|view\s+(profile|website|site)|see\s+(more|profile)|learn\s+more|read\s+more|profile|contact|directions|call|email|share|compare)$"
LISTED_NAME_NOISE = ["http", "www.", "companies are listed", "showing ", "database", "reviews", "rankings", "get access"]
SOCIAL_LINKS = ["facebook.com", "linkedin.com", "twitter.com", "youtube.com"]
LOCAL_PHONE = r"(?<!\d)(?:\+|00)\s*{digits}[\s\-./()]*(?:\d[\s\-./()]*){{7,}}"
FORMER = r"(?i)\b(former|previously|ex-|past employee|alumni|alumna|retired|used to work)\b"
CREDENTIALS = r"(?i),?\s+(?:PMP|MBA|PhD|MSc|BSc|CPA|CELTA|DELTA|MA|BA|JD|MD|MCIL|MITI|ITI|FCIL|Cert\.?\s*\w*)\b.*$"
CORPORATE_SUFFIX = r"(?i)[,\s]+(inc|llc|ltd|gmbh|sa|sas|sarl|co|corp|corporation|incorporated|limited|company|group|holding|holdings|sl|srl|sp\.?\s*z\s*o\.?o\.?|kft|pvt|ag|kg|nv|bv)\.?\s*$"
SITE_ENDING = r"(?i)\.(com|org|net|io|co|ai|app|dev|me|uk|us|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|cz|ru|jp|cn|kr|in|au|nz|br|mx|cl|ar|za|ae|sg|hk|tw|tr|gr|pt|ie|ro|hu|ua)\b"
BAD_NAME_TOKENS = ["undefined", "null", "n/a", "jr", "sr", "ii", "iii", "iv", "phd", "mba", "ma", "linkedin", "member"]
CARD_JUNK = ["see profile", "view profile", "connect", "follow", "message", "show more", "show less", "1st", "2nd", "3rd", "1st degree connection", "2nd degree connection", "premium", "open to work", "linkedin"]
NOBODY = ["linkedin member", "linkedin user", "member"]
CORPORATE_WORDS = [
    "inc", "llc", "ltd", "gmbh", "corp", "corporation", "limited", "company", "group", "holding", "holdings", "sa", "sas", "sarl", "ag", "bv", "nv", "plc", "sl", "srl", "kft",
]
TITLE_HINT = (
    r"(?i)\b(manager|director|head|vp|vice president|ceo|coo|cto|cfo|founder|owner|engineer|specialist|coordinator|lead|partner|president|chief|officer|consultant|analyst|architect|developer|"
    r"designer|strategist|principal|associate|executive|administrator|linguist|translator|interpreter|reviewer|editor|content|localization|localisation|translation|language|globalization)\b"
)
EXAMPLE_FIRST = ["john", "jane", "james", "william", "michael"]
EXAMPLE_LAST = ["smith", "doe", "jones", "williams", "brown", "taylor", "davis", "miller", "wilson", "moore", "anderson", "white"]
VERIFIED_TAGS = {"ai_overview": "ai_overview_verified", "local_pack": "local_pack_verified", "directory": "directory_verified", "serp_summary": "serp_summary_verified"}
STATUSES = ["qualified", "rejected", "failed", "unreachable", "discovered"]


def industry_keywords(slug: str | None) -> list[str]:
    """Keywords of an industry; those of language services where it is not listed or not named."""
    return INDUSTRY_KEYWORDS.get((slug or "").strip().lower()) or RELEVANCE_KEYWORDS


def is_strong(term: str, markers: list[str] = STRONG_MARKERS, ambiguous: list[str] = AMBIGUOUS_TERMS) -> bool:
    """A term that shows the industry by itself: not ambiguous, and a marker lies in it or it in a marker."""
    return term not in ambiguous and any(m in term or term in m for m in markers)
