"""Word lists behind the synthetic values."""

# The results of the synthetic steps depend on these lists and on their order.
FIRST_NAMES = [
    "Anna", "Lena", "Sophie", "Maria", "Julia", "Laura", "Sarah", "Lisa", "Katharina", "Nina",
    "Thomas", "Michael", "Andreas", "Stefan", "Markus", "Daniel", "Christian", "Martin", "Peter",
    "Tobias", "Jonas", "Lukas", "Felix", "David", "Jan", "Paul", "Fritz", "Hans", "Klaus", "Werner",
]
LAST_NAMES = [
    "Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Schulz",
    "Hoffmann", "Koch", "Bauer", "Richter", "Klein", "Wolf", "Schröder", "Neumann", "Schwarz",
    "Zimmermann", "Braun", "Krüger", "Hofmann", "Hartmann", "Lange", "Krause", "Lehmann", "Schmid",
    "Schulze", "Maier", "Köhler",
]
CITIES = [
    "Berlin", "Hamburg", "München", "Köln", "Frankfurt", "Stuttgart", "Düsseldorf", "Leipzig",
    "Dortmund", "Essen", "Bremen", "Dresden", "Hannover", "Nürnberg", "Wien", "Zürich", "Basel",
    "Graz", "Linz", "Salzburg",
]
COUNTRIES = [
    "Deutschland", "Österreich", "Schweiz", "Frankreich", "Italien", "Spanien", "Niederlande",
    "Belgien", "Polen", "Tschechien", "Dänemark", "Schweden", "Norwegen", "Portugal", "Irland",
]
STREETS = [
    "Hauptstraße", "Bahnhofstraße", "Gartenstraße", "Schulstraße", "Dorfstraße", "Lindenstraße",
    "Bergstraße", "Birkenweg", "Kirchgasse", "Ringstraße", "Am Markt", "Parkweg", "Wiesenweg",
    "Mühlweg", "Goethestraße",
]
COMPANIES = [
    "Nordwind GmbH", "Alpenbau AG", "Rheindata GmbH", "Seestern KG", "Blautech GmbH",
    "Mustermann AG", "Sonnenhof GmbH", "Brückner & Co", "Kontor 7 GmbH", "Vento Solutions",
]
DOMAINS = ["example.org", "example.com", "mail.example", "test.example", "demo.example"]
BICS = [
    "NORDDEFFXXX", "MUSTDEFF", "RHEIDEFFXXX", "SEESDEFF", "BLAUDEFFXXX", "SONNDEFF",
    "KONTDEFFXXX", "VENTDEFF", "ALPEDEFFXXX", "MAINDEFF", "HANSDEFFXXX", "DONADEFF",
]
LOREM = [
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed",
    "eiusmod", "tempor", "incididunt", "labore", "dolore", "magna", "aliqua", "enim", "veniam",
    "quis", "nostrud", "aute", "irure", "reprehenderit", "voluptate",
]
ORG_NAMES = [
    "Nordwind", "Alpenbau", "Rheindata", "Seestern", "Blautech", "Sonnenhof", "Brückner",
    "Kontor", "Vento", "Maintal", "Hanse", "Donau", "Spree", "Isar", "Elbtal", "Taunus",
    "Westfalen", "Allgäu", "Saturn", "Merkur", "Atlas", "Orbit", "Delta", "Vertex", "Pioneer",
    "Horizont", "Fokus", "Prime", "Synergie", "Matrix",
]
LEGAL_FORMS = ["GmbH", "AG", "GmbH & Co. KG", "KG", "SE", "mbH", "UG"]

# What marks a name as an organisation or a public authority.
ORG_PATTERN = r"(GmbH|AG|KG|e\.?V\.?|SE|mbB|mbH|UG|gGmbH|& Co|Inc\.?|Ltd|SARL|Pty|s\.r\.o)"
AUTHORITY_PATTERN = (
    r"(?i)(finanzamt|krankenkasse|AOK|sozialvers|\bkasse\b|stadt |gemeinde|bundes|zoll"
    r"|berufsgenossenschaft)"
)

# Labels that rare entities share.
RARE_PERSON = "Weitere Personen (Sammel)"
RARE_ORG = "Weitere Organisationen (Sammel)"
RARE_LABELS = {
    "email": "weitere@example.org",
    "phone": "+49 000 0000000",
    "zip": "00000",
    "street": "Sammelstraße 0",
    "iban": "DE36000000000000000000",
}
