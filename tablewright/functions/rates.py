"""Travel rates: full day and night abroad, and the rules around them."""

# Country code, name, full day in EUR, night in EUR (2025).
ABROAD = (
    ("AT", "Österreich", 40, 108),
    ("BE", "Belgien", 42, 141),
    ("BG", "Bulgarien", 22, 115),
    ("HR", "Kroatien", 35, 120),
    ("CZ", "Tschechien", 33, 97),
    ("DK", "Dänemark", 75, 183),
    ("EE", "Estland", 29, 85),
    ("FI", "Finnland", 50, 171),
    ("FR", "Frankreich", 44, 115),
    ("FR-PAR", "Frankreich – Paris", 58, 159),
    ("GR", "Griechenland", 40, 132),
    ("HU", "Ungarn", 32, 90),
    ("IE", "Irland", 58, 165),
    ("IT", "Italien", 40, 155),
    ("IT-ROM", "Italien – Rom", 40, 160),
    ("IT-MIL", "Italien – Mailand", 45, 158),
    ("LU", "Luxemburg", 63, 134),
    ("NL", "Niederlande", 47, 129),
    ("NO", "Norwegen", 80, 182),
    ("PL", "Polen", 33, 117),
    ("PL-WAW", "Polen – Warschau", 30, 143),
    ("PT", "Portugal", 36, 102),
    ("RO", "Rumänien", 27, 92),
    ("ES", "Spanien", 34, 128),
    ("ES-MAD", "Spanien – Madrid", 40, 136),
    ("ES-BCN", "Spanien – Barcelona", 34, 144),
    ("SE", "Schweden", 66, 140),
    ("CH", "Schweiz", 64, 180),
    ("CH-GEN", "Schweiz – Genf", 66, 186),
    ("SK", "Slowakei", 33, 100),
    ("SI", "Slowenien", 38, 143),
    ("GB", "Vereinigtes Königreich", 45, 121),
    ("GB-LON", "Vereinigtes Königreich – London", 62, 224),
    ("TR", "Türkei", 26, 95),
    ("TR-IST", "Türkei – Istanbul", 30, 135),
    ("US", "USA", 59, 234),
    ("US-NYC", "USA – New York City", 66, 308),
    ("US-WAS", "USA – Washington, D.C.", 66, 311),
    ("US-SFO", "USA – San Francisco", 66, 327),
    ("US-LAX", "USA – Los Angeles", 64, 242),
    ("CA", "Kanada", 47, 178),
    ("MX", "Mexiko", 41, 141),
    ("BR", "Brasilien", 51, 171),
    ("CN", "China", 39, 116),
    ("CN-PEK", "China – Peking", 34, 135),
    ("CN-SHA", "China – Shanghai", 45, 288),
    ("HK", "Hongkong", 74, 207),
    ("JP", "Japan", 51, 156),
    ("JP-TYO", "Japan – Tokio", 66, 233),
    ("SG", "Singapur", 54, 223),
    ("AE-DXB", "VAE – Dubai", 65, 156),
    ("IN", "Indien", 33, 155),
    ("TH", "Thailand", 40, 140),
    ("AU", "Australien", 60, 173),
    ("ZA", "Südafrika", 29, 119),
)

# Rates at home in EUR, share of the full day abroad on short days,
# cut per provided meal as a share of the full day.
HOME = "DE"
HOME_FULL, HOME_SHORT, HOME_NIGHT = 28, 14, 20
ABROAD_SHORT = 0.80
MEAL_CUTS = {"breakfast": 0.20, "lunch": 0.40, "dinner": 0.40}
