"""Short word lists for the text columns."""

FIRST_NAMES = [
    "Ada", "Amir", "Ana", "Bela", "Bruno", "Chen", "Clara", "Dario", "Dina", "Elif",
    "Emil", "Farah", "Felix", "Greta", "Hana", "Hugo", "Ines", "Ivan", "Jana", "Jonas",
    "Kaya", "Kofi", "Lena", "Luis", "Mara", "Milan", "Nadia", "Nils", "Olga", "Omar",
    "Paula", "Pavel", "Rosa", "Ruben", "Sana", "Tariq", "Uma", "Vera", "Yusuf", "Zoe",
]
LAST_NAMES = [
    "Abel", "Baker", "Berg", "Castro", "Costa", "Dahl", "Diaz", "Engel", "Fischer", "Garcia",
    "Grant", "Haddad", "Hill", "Ito", "Jansen", "Kaur", "Khan", "Kim", "Lang", "Lopez",
    "Marin", "Mendez", "Moreau", "Nakamura", "Novak", "Okafor", "Olsen", "Park", "Petrov", "Quinn",
    "Rossi", "Santos", "Sato", "Silva", "Stone", "Tanaka", "Vargas", "Weber", "Yilmaz", "Zhang",
]
COMPANY_SUFFIXES = ["Ltd", "Inc", "Group", "Partners", "Logistics", "Systems", "Trading", "and Sons"]
MAIL_DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com"]
STREETS = [
    "Oak Street", "Mill Lane", "Station Road", "High Street", "River Walk", "Park Avenue",
    "Harbor Road", "Cedar Court", "Church Street", "Lake Drive", "Market Square", "Garden Way",
]
CITIES = [
    "Ashford", "Bayview", "Brookfield", "Carlton", "Dunmore", "Eastport", "Fairhaven", "Glenwood",
    "Hartley", "Ironbridge", "Kingsford", "Lakeside", "Milltown", "Northgate", "Oakdale", "Pinehurst",
    "Queensbury", "Riverton", "Southbank", "Thornton", "Upton", "Westbrook", "Wexford", "Yarrow",
]
COUNTRIES = [
    "Argentina", "Australia", "Austria", "Brazil", "Canada", "Chile", "Denmark", "Egypt",
    "Finland", "France", "Germany", "Ghana", "India", "Indonesia", "Italy", "Japan",
    "Kenya", "Mexico", "Morocco", "Netherlands", "Nigeria", "Norway", "Peru", "Poland",
    "Portugal", "Spain", "Sweden", "Thailand", "Turkey", "Vietnam",
]
JOBS = [
    "Accountant", "Architect", "Baker", "Biologist", "Buyer", "Carpenter", "Chemist", "Clerk",
    "Data analyst", "Dentist", "Designer", "Driver", "Economist", "Editor", "Electrician", "Engineer",
    "Farmer", "Geologist", "Lawyer", "Librarian", "Mechanic", "Nurse", "Pharmacist", "Pilot",
    "Planner", "Plumber", "Printer", "Surveyor", "Teacher", "Translator", "Vet", "Welder",
]
SENTENCE_WORDS = [
    "about", "above", "account", "across", "after", "again", "answer", "area", "arrive", "before",
    "begin", "below", "better", "bring", "build", "change", "choice", "city", "clear", "close",
    "common", "cost", "cover", "daily", "early", "enough", "field", "final", "first", "follow",
    "front", "future", "general", "given", "great", "group", "heavy", "house", "human", "inside",
    "later", "letter", "level", "light", "little", "local", "market", "matter", "moment", "money",
    "never", "night", "number", "office", "often", "order", "paper", "people", "place", "plan",
    "point", "power", "public", "reason", "report", "result", "river", "round", "simple", "small",
    "south", "still", "store", "table", "today", "total", "under", "value", "water", "window",
]

PRODUCT_ADJECTIVES = ["Amber", "Brisk", "Compact", "Durable", "Folding", "Golden", "Light", "Modern", "Quiet", "Sturdy"]
PRODUCT_NOUNS = ["Basket", "Bracket", "Cable", "Filter", "Handle", "Kettle", "Lantern", "Pump", "Ratchet", "Valve"]

# Postal abbreviations of the fifty states.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
