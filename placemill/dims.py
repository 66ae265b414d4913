"""Reference tables: categories, classes, providers, picture sources, languages."""

from __future__ import annotations

from dataclasses import dataclass

@dataclass(frozen=True)
class Category:
    id: str
    label: str
    tokens: tuple[str, ...]
    selectors: tuple[str, ...]


# ---------------------------------------------------------------------------
# Fixed values. A selector is a list of conditions joined by "&": "k" exists,
# "k=v" equals, "k~re" matches.
# ---------------------------------------------------------------------------
CATEGORIES = [
    Category(
        "tourism", "Tourist attraction",
        (
            "tourist place", "tourist places", "tourist attraction", "tourist attractions", "tourist spot", "tourism", "sightseeing",
            "places to visit", "attractions", "landmarks", "landmark",
        ),
        (
            "tourism~^(attraction|museum|gallery|artwork|viewpoint|zoo|theme_park|aquarium|picnic_site|information)$", "historic",
            "leisure~^(park|garden|nature_reserve)$",
        ),
    ),
    Category(
        "historic", "Historical site",
        (
            "historical site", "historical sites", "historic", "historical", "heritage", "monument", "monuments", "fort", "forts", "ruins",
            "archaeological",
        ),
        (
            "historic", "heritage", "tourism=museum & museum~history|local",
        ),
    ),
    Category(
        "museum", "Museum",
        (
            "museum", "museums", "gallery", "galleries", "art gallery",
        ),
        (
            "tourism~^(museum|gallery)$",
        ),
    ),
    Category(
        "cafe", "Cafe",
        (
            "cafe", "cafes", "coffee", "coffee shop", "coffee shops", "coffeehouse",
        ),
        (
            "amenity=cafe", "cuisine~coffee_shop",
        ),
    ),
    Category(
        "restaurant", "Restaurant",
        (
            "restaurant", "restaurants", "food", "dining", "eatery", "eateries", "fast food", "diner",
        ),
        (
            "amenity~^(restaurant|fast_food|food_court)$",
        ),
    ),
    Category(
        "bar", "Bar / nightlife",
        (
            "bar", "bars", "pub", "pubs", "nightlife", "nightclub", "club",
        ),
        (
            "amenity~^(bar|pub|nightclub|biergarten)$",
        ),
    ),
    Category(
        "hotel", "Hotel",
        (
            "hotel", "hotels", "accommodation", "lodging", "guest house", "guesthouse", "hostel", "resort", "resorts", "motel", "stay",
        ),
        (
            "tourism~^(hotel|motel|guest_house|hostel|resort|apartment|chalet)$",
        ),
    ),
    Category(
        "university", "University",
        (
            "university", "universities", "uni", "higher education",
        ),
        (
            "amenity=university",
        ),
    ),
    Category(
        "college", "College",
        (
            "college", "colleges", "institute", "institutes", "polytechnic",
        ),
        (
            "amenity~^(college|university)$", "building=college",
        ),
    ),
    Category(
        "school", "School",
        (
            "school", "schools", "kindergarten", "academy",
        ),
        (
            "amenity~^(school|kindergarten)$",
        ),
    ),
    Category(
        "hospital", "Hospital",
        (
            "hospital", "hospitals", "clinic", "clinics", "medical", "healthcare", "health care", "doctor", "doctors",
        ),
        (
            "amenity~^(hospital|clinic|doctors)$", "healthcare~^(hospital|clinic|centre|doctor)$",
        ),
    ),
    Category(
        "pharmacy", "Pharmacy",
        (
            "pharmacy", "pharmacies", "chemist", "drugstore", "medical store",
        ),
        (
            "amenity=pharmacy", "healthcare=pharmacy",
        ),
    ),
    Category(
        "company", "Company / office",
        (
            "company", "companies", "office", "offices", "business", "businesses", "corporate", "startup", "startups", "it company", "it companies",
            "firm", "firms", "agency", "agencies",
        ),
        (
            "office", "amenity=coworking_space",
        ),
    ),
    Category(
        "bank", "Bank",
        (
            "bank", "banks", "banking", "atm", "atms", "financial",
        ),
        (
            "amenity~^(bank|bureau_de_change)$", "office~^(financial|insurance)$",
        ),
    ),
    Category(
        "park", "Park",
        (
            "park", "parks", "garden", "gardens", "green space", "playground", "recreation",
        ),
        (
            "leisure~^(park|garden|nature_reserve|playground|recreation_ground)$",
        ),
    ),
    Category(
        "mall", "Shopping",
        (
            "mall", "malls", "shopping", "shopping centre", "shopping center", "market", "markets", "bazaar", "supermarket", "grocery", "store",
            "stores",
        ),
        (
            "shop~^(mall|department_store|supermarket|wholesale)$", "amenity=marketplace",
        ),
    ),
    Category(
        "worship", "Place of worship",
        (
            "mosque", "mosques", "masjid", "church", "churches", "temple", "temples", "place of worship", "places of worship", "shrine", "shrines",
            "synagogue", "religious",
        ),
        (
            "amenity=place_of_worship", "historic~^(shrine|tomb|wayside_shrine)$",
        ),
    ),
    Category(
        "library", "Library",
        (
            "library", "libraries", "archive", "archives",
        ),
        (
            "amenity~^(library|archive)$",
        ),
    ),
    Category(
        "gym", "Gym / fitness",
        (
            "gym", "gyms", "fitness", "fitness centre", "sports", "stadium", "sports club",
        ),
        (
            "leisure~^(fitness_centre|sports_centre|stadium|sports_hall|pitch)$",
        ),
    ),
    Category(
        "cinema", "Cinema / theatre",
        (
            "cinema", "cinemas", "movie", "movies", "theatre", "theater", "theatres", "entertainment",
        ),
        (
            "amenity~^(cinema|theatre|arts_centre)$",
        ),
    ),
    Category(
        "beach", "Beach",
        (
            "beach", "beaches", "waterfront", "seaside", "coast",
        ),
        (
            "natural=beach", "leisure=beach_resort",
        ),
    ),
    Category(
        "transport", "Transport hub",
        (
            "airport", "airports", "bus station", "railway", "railway station", "train station", "metro", "subway", "transport", "terminal", "port",
            "seaport",
        ),
        (
            "aeroway~^(aerodrome|terminal)$", "railway~^(station|halt)$", "amenity=bus_station", "public_transport=station",
        ),
    ),
    Category(
        "fuel", "Fuel station",
        (
            "petrol", "petrol pump", "gas station", "fuel", "filling station", "charging station",
        ),
        (
            "amenity~^(fuel|charging_station)$",
        ),
    ),
    Category(
        "government", "Government / civic",
        (
            "government", "civic", "police", "police station", "fire station", "court", "embassy", "consulate", "town hall", "municipal",
            "public office",
        ),
        (
            "amenity~^(police|fire_station|townhall|courthouse|embassy|post_office)$", "office~^(government|diplomatic|administrative)$",
        ),
    ),
]
CATEGORY_BY_ID = {c.id: c for c in CATEGORIES}

GENERIC_KEYS = ["amenity", "shop", "tourism", "leisure", "office", "healthcare", "historic", "craft", "building", "club", "landuse"]
LABEL_KEYS = ["amenity", "tourism", "historic", "shop", "leisure", "office", "healthcare", "aeroway", "railway", "natural", "craft"]

# Category id to knowledge-base classes.
CLASSES = {
    "tourism": ["Q570116", "Q33506", "Q839954", "Q2065736"],
    "historic": ["Q839954", "Q2065736", "Q570116", "Q4989906"],
    "museum": ["Q33506", "Q207694"],
    "worship": ["Q1370598", "Q32815", "Q16970", "Q842402"],
    "university": ["Q3918", "Q875538"],
    "college": ["Q189004", "Q3918"],
    "school": ["Q3914"],
    "hospital": ["Q16917"],
    "park": ["Q22698"],
    "library": ["Q7075"],
    "cinema": ["Q41253", "Q24354"],
    "hotel": ["Q27686"],
    "transport": ["Q1248784", "Q55488"],
    "beach": ["Q40080"],
    "mall": ["Q11315"],
}

CHAIN_KEYS = ["shop", "amenity", "tourism", "healthcare", "office"]
CHAIN_VALUES = [
    "cafe", "restaurant", "fast_food", "bar", "pub", "ice_cream", "bakery", "bank", "atm", "pharmacy", "fuel", "convenience", "supermarket",
    "clothes", "hairdresser", "car_repair", "hotel", "motel", "guest_house", "clinic", "doctors", "dentist", "kindergarten", "post_office",
    "toilets", "parking", "bus_station", "bicycle_parking",
]

RELEVANT_TAGS = [
    "name", "name:en", "int_name", "alt_name", "description", "description:en", "amenity", "tourism", "historic", "heritage", "shop", "leisure",
    "office", "healthcare", "aeroway", "railway", "natural", "building", "craft", "operator", "brand", "cuisine", "denomination", "religion",
    "stars", "capacity", "rooms", "beds", "website", "contact:website", "url", "phone", "contact:phone", "contact:mobile", "email", "contact:email",
    "opening_hours", "wheelchair", "fee", "internet_access", "addr:housenumber", "addr:street", "addr:suburb", "addr:neighbourhood", "addr:city",
    "addr:district", "addr:state", "addr:postcode", "wikipedia", "wikidata", "start_date", "inscription",
]

FACTS = [
    ("P31", "Instance of"),
    ("P571", "Founded / built"),
    ("P1619", "Officially opened"),
    ("P84", "Architect"),
    ("P149", "Architectural style"),
    ("P138", "Named after"),
    ("P170", "Creator"),
    ("P127", "Owned by"),
    ("P137", "Operator"),
    ("P1435", "Heritage status"),
    ("P2048", "Height"),
    ("P2046", "Area"),
    ("P1174", "Visitors per year"),
    ("P856", "Official website"),
    ("P131", "Located in"),
    ("P17", "Country"),
]

LANGUAGES = {
    "cn": "zh", "tw": "zh", "hk": "zh", "jp": "ja", "kr": "ko", "ru": "ru", "ua": "uk", "sa": "ar", "ae": "ar", "eg": "ar",
    "ir": "fa", "pk": "ur", "in": "hi", "th": "th", "vn": "vi", "gr": "el", "il": "he", "tr": "tr", "de": "de", "fr": "fr",
    "es": "es", "it": "it", "pt": "pt", "br": "pt", "pl": "pl", "nl": "nl",
}

# Picture sources from the surest to the least sure, with the weight of each.
SOURCE_WEIGHTS = {
    "google": 11, "wikidata": 10, "wikipedia": 9, "commons-category": 8, "commons-geo": 7, "flickr": 6,
    "wikipedia-article": 5, "europeana": 4, "commons": 3, "openverse": 2, "unsplash": 1,
}
PLACE_SPECIFIC_SOURCES = ["wikidata", "wikipedia", "commons-category", "wikipedia-article", "google"]

# Order in which picture sources are asked, and how many a source may add while
# r pictures are still missing: factor * r, at most ceiling (None = no bound).
WATERFALL = [
    ("wikidata", None, None), ("wikipedia", None, 1), ("commons-category", 3, 40), ("wikipedia-article", 3, None),
    ("commons-geo", 1, None), ("flickr", 1, None), ("europeana", 1, None), ("commons", 2, 12),
    ("openverse", 2, 20), ("unsplash", 1, 5),
]

ALLOWED_MIME = ["image/jpeg", "image/png", "image/webp", "image/tiff", "image/jpg"]
ALLOWED_HOSTS = [
    "upload.wikimedia.org", "commons.wikimedia.org", "www.wikidata.org", "images.unsplash.com", "plus.unsplash.com", "live.staticflickr.com",
    "www.flickr.com", "api.europeana.eu", "proxy.europeana.eu", "api.openverse.org", "api.openverse.engineering", "farm1.staticflickr.com",
    "farm2.staticflickr.com", "farm3.staticflickr.com", "farm4.staticflickr.com", "farm5.staticflickr.com", "farm6.staticflickr.com",
    "farm8.staticflickr.com", "farm9.staticflickr.com",
]
FURNITURE_WORDS = "icon|logo|flag|symbol|edit|commons-logo|wiki|ambox|question|padlock|arrow"

FLICKR_LICENSES = {
    "1": "CC BY-NC-SA 2.0", "2": "CC BY-NC 2.0", "3": "CC BY-NC-ND 2.0", "4": "CC BY 2.0", "5": "CC BY-SA 2.0",
    "6": "CC BY-ND 2.0", "7": "No known copyright restrictions", "8": "United States Government Work",
    "9": "CC0 1.0", "10": "Public Domain Mark 1.0",
}

# Travel providers: id, label, kind, address, countries, portal without a search.
PROVIDERS = [
    ("tripadvisor", "Tripadvisor", "reviews", "https://www.tripadvisor.com/Search?q=", None, False),
    ("viator", "Viator", "tours", "https://www.viator.com/searchResults/all?text=", None, False),
    ("getyourguide", "GetYourGuide", "tours", "https://www.getyourguide.com/s/?q=", None, False),
    ("tripcom", "Trip.com", "booking", "https://www.trip.com/things-to-do/list?keyword=", None, False),
    ("chinahighlights", "China Highlights", "guide", "https://www.chinahighlights.com/search-result/?q=", ["CN", "HK", "MO"], False),
    ("travelchina", "Travel China", "reference", "https://www.travelchina.org.cn/en/", ["CN", "HK", "MO"], True),
]
DEFAULT_PROVIDERS = ["tripadvisor", "viator", "getyourguide", "tripcom"]
GENERIC_TYPES = ["point_of_interest", "establishment", "premise", "political", "geocode"]

MAX_RESULTS = 300
HD_WIDTH = 1600
IMAGES_PER_PLACE = 10
MAX_IMAGES_PER_PLACE = 24
DUPLICATE_COSINE = 0.92
CHAIN_RADIUS_M = 250.0
CACHE_TTL_SECONDS = 6 * 3600
# End of the fixed values.
