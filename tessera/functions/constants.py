"""Fixed values that results depend on: patterns, word lists, weights and limits."""

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = "(?:" + "|".join([
    r"\+?66[\s\-]?\d[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?86[\s\-]?\d{2,3}[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?65[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?852[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?60[\s\-]?\d{1,2}[\s\-]?\d{3,4}[\s\-]?\d{4}",
    r"\+?84[\s\-]?\d{1,2}[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?63[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{4}",
    r"\+?62[\s\-]?\d{2,3}[\s\-]?\d{4}[\s\-]?\d{4}",
    r"\+?1[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}",
    r"\(?\d{3}\)?[\s\-]\d{3}[\s\-]\d{4}",
]) + ")"
WECHAT = r"(?:微信|wechat|weixin|wx)[\s:：#号]*([a-zA-Z0-9_\-]{5,30})"
LINE = r"(?:line[\s]?id|line@|line号)[\s:：]*([a-zA-Z0-9_@.\-]{3,30})"
HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}]"
ORG_HEAD = r"[A-Z][a-zA-Z\s一-鿿]{1,40}"
LOCATIONS = [
    "Thailand", "Bangkok", "Chiang Mai", "Phuket", "China", "Beijing", "Shanghai", "Guangzhou", "Shenzhen", "Chengdu", "Singapore", "Hong Kong", "Malaysia", "Kuala Lumpur",
    "Vietnam", "Hanoi", "Ho Chi Minh", "Indonesia", "Jakarta", "Philippines", "Manila", "Myanmar", "Yangon", "Cambodia", "Phnom Penh", "Laos", "Vientiane", "Japan", "Tokyo",
    "Seoul", "Korea", "泰国", "中国", "北京", "上海", "广州", "新加坡", "香港", "马来西亚", "越南", "东南亚", "亚洲",
]
ORG_SUFFIXES = ["Co.", "Ltd.", "Corp.", "Inc.", "LLC", "Group", "Holdings", "International", "Enterprise", "Services", "Solutions", "Agency", "Association", "集团", "公司", "有限公司", "股份", "机构", "协会"]
CAPS = {"emails": 20, "phones": 20, "wechat": 10, "line_ids": 10, "locations": 15, "organizations": 15}
CLUSTERS = {
    "sports": "football soccer basketball tennis swimming athletics training camp tournament league coach academy sport athlete fitness gym competition championship".split(),
    "travel": "tour travel trip holiday vacation hotel resort booking accommodation flight destination itinerary guide agency package excursion".split(),
    "business": "company corporation enterprise solution service consulting management strategy investment partner industry market professional commercial".split(),
    "contact": "contact reach email phone address office headquarters inquiry support sales info".split(),
    "education": "school university college institute training course program learning education study class".split(),
}
#: Of each mode the weights of keyword frequency, clusters, contacts, length, languages, metadata and links.
COMPONENTS = ["keyword_freq", "semantic_cluster", "contact_presence", "content_length", "multilingual", "metadata_quality", "link_authority"]
WEIGHTS = {"personal": [30, 15, 15, 15, 8, 10, 7], "research": [20, 25, 10, 8, 10, 7, 20], "leadgen": [15, 10, 40, 5, 15, 5, 10]}
#: Crawling limits.
MAX_DEPTH, MAX_PER_DOMAIN, MAX_SEEDS, LOW_SCORE, EDGES_PER_PAGE, LINKS_PER_PAGE = 5, 50, 200, 10, 50, 300
PROFILES = {"light": (10, 2, 1, 1.5), "medium": (30, 8, 2, 0.5), "heavy": (80, 20, 3, 0.1)}
BLOCKED = "google-analytics.com googletagmanager.com doubleclick.net facebook.net twitter.com linkedin.com amazon-adsystem.com hotjar.com intercom.io segment.com mixpanel.com".split()
SKIPPED = (
    "facebook.com twitter.com instagram.com youtube.com wikipedia.org linkedin.com reddit.com pinterest.com tiktok.com duckduckgo.com bing.com google.com amazon.com apple.com microsoft.com t.co "
    "lite.duckduckgo.com yahoo.com search.yahoo.com brave.com ecosia.org w3.org schemas.live.com yimg.com s.yimg.com"
).split()
NOISE_TAGS = "nav header footer aside script style noscript iframe form button input select".split()
NOISE_STYLE = r"display\s*:\s*none|visibility\s*:\s*hidden"
NOISE_CLASS = r"cookie|banner|popup|modal|overlay|ad-|ads-"
META_NAMES = ["description", "keywords", "author", "robots"]
OG_NAMES = ["og:title", "og:description", "og:image", "og:type", "og:url", "og:site_name"]
TWITTER_NAMES = ["twitter:title", "twitter:description", "twitter:image"]
#: Regions by the first key that a query holds, in order: of queries to expand, and of queries to search.
REGIONS = {
    "expand": [
        ("sea", "southeast asia;se asia;thailand;bangkok;phuket;chiang mai;singapore;malaysia;kuala lumpur;vietnam;ho chi minh;hanoi;indonesia;jakarta;bali;philippines;manila;myanmar;cambodia;laos;brunei"),
        ("china", "china;hong kong;macau;taiwan;beijing;shanghai;shenzhen;guangzhou;chengdu"), ("japan", "japan;tokyo;osaka"), ("korea", "south korea;korea;seoul"),
        ("europe", "switzerland;france;germany;spain;italy;portugal;netherlands;belgium;austria;sweden;norway;denmark;uk;united kingdom;england;europe;european"),
        ("north_america", "usa;united states;canada"), ("middle_east", "dubai;uae;qatar;saudi;middle east"), ("oceania", "australia;new zealand"),
        ("latam", "brazil;argentina;mexico;latin america"), ("south_asia", "india;pakistan"), ("europe", "russia;ukraine"),
    ],
    "search": [
        ("sea", "southeast asia;se asia;thailand;bangkok;singapore;malaysia;vietnam;indonesia;philippines;myanmar;cambodia"), ("china", "hong kong;china;macau;taiwan;beijing;shanghai;shenzhen"),
        ("japan", "japan;tokyo"), ("korea", "korea;seoul"), ("europe", "switzerland;france;germany;spain;italy;uk;england;europe"), ("north_america", "usa;united states;canada"),
        ("middle_east", "dubai;uae"), ("oceania", "australia;new zealand"),
    ],
}
CITIES = {
    "sea": ["Bangkok", "Singapore", "Kuala Lumpur"], "china": ["Beijing", "Shanghai", "Shenzhen"], "japan": ["Tokyo", "Osaka", "Kyoto"], "korea": ["Seoul", "Busan", "Incheon"],
    "north_america": ["New York", "Los Angeles", "Toronto"], "middle_east": ["Dubai", "Abu Dhabi", "Doha"], "oceania": ["Sydney", "Melbourne", "Auckland"],
    "latam": ["São Paulo", "Mexico City", "Buenos Aires"], "south_asia": ["Mumbai", "Delhi", "Bangalore"], "europe": [],
}
AUTO_LANGS = {"sea": ["zh", "th", "ms", "vi"], "china": ["zh", "zh_tw"], "japan": ["ja"], "korea": ["ko"], "europe": ["de", "nl", "fr", "es", "it"], "latam": ["es", "pt"], "middle_east": ["ar"]}
EUROPE_LANGS = {"de": ["germany", "austria", "switzerland"], "nl": ["netherlands", "belgium"], "fr": ["france", "belgium", "switzerland"], "es": ["spain"], "it": ["italy"]}
SUFFIXES = {
    "leadgen": {
        "sports": ["academy", "club"], "travel": ["travel agent", "tour operator"], "food": ["supplier wholesale", "distributor contact"], "tech": ["vendor reseller", "partner contact"],
        "business": ["company supplier", "contact email"], "finance": ["firm contact", "services email"], "education": ["institute contact", "school email"], "health": ["clinic contact", "provider email"],
        "legal": ["law firm contact", "attorney email"], "realestate": ["agency contact", "agent email"], "retail": ["wholesaler contact", "distributor email"],
        "manufacturing": ["factory supplier", "OEM contact"], "fashion": ["brand wholesale", "supplier contact"], "automotive": ["dealer contact", "fleet email"],
        "logistics": ["freight forwarder contact", "shipper email"], "marketing": ["agency contact", "services email"], "construction": ["contractor contact", "builder email"],
        "events": ["planner contact", "organizer email"],
    },
    "research": {
        "sports": ["industry association federation", "market overview"], "travel": ["tourism statistics industry", "market report"], "tech": ["landscape ecosystem report", "market analysis"],
        "business": ["industry report market", "sector overview"], "finance": ["market report regulatory", "sector analysis"], "education": ["statistics enrollment report"],
        "health": ["industry report healthcare market"], "manufacturing": ["industry report output statistics"], "energy": ["market report capacity statistics"],
        "agriculture": ["industry statistics production report"], "crypto": ["market cap report ecosystem"], "gaming": ["market report revenue statistics"],
    },
}
TECH = {
    "WordPress": ["wp-content", "wp-includes", "WordPress"], "React": ["react", "__NEXT_DATA__", "_next/static"], "Next.js": ["__NEXT_DATA__", "_next/"], "Vue.js": ["vue.js", "vue.min.js", "__vue__"],
    "Angular": ["ng-version", "angular.js", "ng-app"], "Shopify": ["shopify", "cdn.shopify.com", "Shopify.theme"], "Wix": ["wix.com", "parastorage.com"], "Squarespace": ["squarespace", "sqspcdn.com"],
    "Bootstrap": ["bootstrap.css", "bootstrap.min.css"], "Tailwind": ["tailwind", "tw-"], "jQuery": ["jquery.js", "jquery.min.js"], "Google Analytics": ["google-analytics.com", "gtag(", "UA-"],
    "Cloudflare": ["cloudflare", "__cf_"],
}
ANALYTICS = {
    "Google Analytics": ["google-analytics.com", "gtag(", "GoogleAnalyticsObject"], "Google Tag Manager": ["googletagmanager.com", "GTM-"], "Facebook Pixel": ["connect.facebook.net", "fbq("],
    "Hotjar": ["hotjar.com", "hj("], "Mixpanel": ["mixpanel.com", "mixpanel.track"], "Segment": ["segment.com", "analytics.js"], "Intercom": ["intercom.io", "Intercom("], "Crisp": ["crisp.chat"],
    "Tawk.to": ["tawk.to"], "HubSpot": ["hs-analytics.net", "hubspot.com/analytics"], "Baidu Analytics": ["hm.baidu.com", "百度统计"],
}
SERVERS = {"nginx": "Nginx", "apache": "Apache", "iis": "IIS", "cloudflare": "Cloudflare", "gunicorn": "Gunicorn", "uwsgi": "uWSGI", "caddy": "Caddy", "litespeed": "LiteSpeed"}
CMS = {
    "WordPress": ["wp-content/", "wp-includes/", "wp-json/"], "Drupal": ["drupal.settings", "/sites/default/files/", "x-generator: drupal"], "Joomla": ["/components/com_", "joomla", "/media/jui/"],
    "Magento": ["mage/", "magento_", "/magento/"], "Shopify": ["cdn.shopify.com", "shopify.com/s/"], "Wix": ["parastorage.com", "wix.com/"], "Squarespace": ["squarespace.com", "sqspcdn.com"],
    "Ghost": ["ghost.io", "/ghost/api/"], "Webflow": ["webflow.com", "webflow"], "HubSpot": ["hs-scripts.com", "hubspot.com"],
}
GENERATOR = r"""<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)"""
FRAMEWORKS = {
    "Next.js": ["__next_data__", "_next/static"], "Nuxt.js": ["__nuxt", "_nuxt/"], "Gatsby": ["gatsby-", "__gatsby"], "Angular": ["ng-version=", "ng-app="], "Vue.js": ["__vue__", "data-v-app"],
    "React": ["react-root", "__reactfiber"], "Svelte": ["svelte-", "__svelte"], "Django": ["csrfmiddlewaretoken", "__admin_media_prefix__"], "Laravel": ["laravel_session", "xsrf-token"],
    "Ruby on Rails": ["authenticity_token", "rails-"], "ASP.NET": ["__viewstate", "asp.net"], "Spring": ["spring", "spring_security"],
}
CDN_HEADERS = [("cloudflare", "Cloudflare"), ("cf-ray", "Cloudflare"), ("x-amz-cf-id", "AWS CloudFront"), ("x-cache", None), ("fastly-io-info", "Fastly"), ("x-fastly", "Fastly"), ("x-akamai", "Akamai"), ("via", None)]
SECURITY_HEADERS = "strict-transport-security content-security-policy x-frame-options x-content-type-options referrer-policy permissions-policy x-xss-protection".split()
KEPT_HEADERS = "server x-powered-by x-generator x-framework x-application x-version via x-cache".split()
SERVER_LANGUAGES = {"php": "PHP", "python": "Python", "ruby": "Ruby", "java": "Java", "asp.net": "ASP.NET", "node.js": "Node.js", "express": "Node.js"}
SOCIALS = {
    "facebook": r"facebook\.com/[\w.]+", "instagram": r"instagram\.com/[\w.]+", "twitter": r"twitter\.com/[\w.]+", "linkedin": r"linkedin\.com/(?:company|in)/[\w\-]+",
    "youtube": r"youtube\.com/(?:channel|user|c)/[\w\-]+", "wechat": r"weixin\.qq\.com|mp\.weixin", "weibo": r"weibo\.com/[\w.]+", "line": r"line\.me/[\w/]+",
}
#: Suffixes of the stemmer, in the order in which they are tried, with what takes their place.
STEM_PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEM_PAST = ["eed", "ed", "ing"]
STEM_MENDED = ("at", "bl", "iz")
STEM_DOUBLED = "lsz"
STEM_DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEM_ADJECTIVES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEM_LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Of research queries what is added by region; queries without a region get the last.
RESEARCH_REGIONS = {"sea": ["Thailand", "Singapore", "Malaysia", "Vietnam"], "europe": ["Germany", "France", "UK"]}
RESEARCH_CHINA, RESEARCH_NOWHERE = "China mainland", "international global"
CONTACT_WORDS = ["contact", "about", "reach", "联系", "お問い合わせ"]


def regions(which: str) -> list[tuple[str, str]]:
    """(key, region) in the order in which they are tried."""
    return [(key, region) for region, keys in REGIONS[which] for key in keys.split(";")]
