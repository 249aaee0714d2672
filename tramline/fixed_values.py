"""Values that must be exactly these for results to be right. All of them are fixed values."""

# Prefecture names, code = position counted from 1.
PREFECTURES = (
    "北海道",
    "青森県",
    "岩手県",
    "宮城県",
    "秋田県",
    "山形県",
    "福島県",
    "茨城県",
    "栃木県",
    "群馬県",
    "埼玉県",
    "千葉県",
    "東京都",
    "神奈川県",
    "新潟県",
    "富山県",
    "石川県",
    "福井県",
    "山梨県",
    "長野県",
    "岐阜県",
    "静岡県",
    "愛知県",
    "三重県",
    "滋賀県",
    "京都府",
    "大阪府",
    "兵庫県",
    "奈良県",
    "和歌山県",
    "鳥取県",
    "島根県",
    "岡山県",
    "広島県",
    "山口県",
    "徳島県",
    "香川県",
    "愛媛県",
    "高知県",
    "福岡県",
    "佐賀県",
    "長崎県",
    "熊本県",
    "大分県",
    "宮崎県",
    "鹿児島県",
    "沖縄県",
)

# Catalogue columns in table order: (column, key in the response, shown).
CATALOG_COLUMNS = (
    ("organization_id", "organization_id", False),
    ("organization", "organization_name", True),
    ("organization_web_url", "organization_web_url", False),
    ("organization_email", "organization_email", False),
    ("feed_id", "feed_id", False),
    ("feed", "feed_name", True),
    ("feed_pref_id", "feed_pref_id", False),
    ("pref", "feed_pref", True),
    ("feed_license_url", "feed_license_url", False),
    ("feed_url", "feed_url", False),
    ("feed_page_url", "feed_page_url", False),
    ("file_uid", "file_uid", False),
    ("file_rid", "file_rid", False),
    ("from_date", "file_from_date", True),
    ("to_date", "file_to_date", True),
    ("license", "feed_license_id", True),
    ("file_url", "file_url", False),
    ("file_stop_url", "file_stop_url", False),
    ("file_route_url", "file_route_url", False),
    ("file_tracking_url", "file_tracking_url", False),
    ("file_last_updated_at", "file_last_updated_at", False),
)

# Route colours (SVG colour keywords).
ROUTE_COLORS = (
    "orangered",
    "blue",
    "green",
    "orange",
    "salmon",
    "greenyellow",
    "yellowgreen",
    "blueviolet",
    "lightskyblue",
    "lightpink",
    "royalblue",
    "palevioletred",
    "gold",
)

# Names of the output files.
OUTPUTS = {
    "routes": "routes.geojson",
    "stops": "stops.geojson",
    "aggregated_routes": "aggregated_routes.geojson",
    "aggregated_stops": "aggregated_stops.geojson",
    "aggregated_csv": "result.csv",
}

# Preset feeds (country, region, name, url).
PRESET_FEEDS = (
    (
        "JPN",
        "北海道",
        "北海道拓殖バス（一般路線バス・各町コミュニティバス）",
        "https://www.takubus.com/app/download/10941479479/GTFS_regular_line.zip?t=1606785205",
    ),
    (
        "JPN",
        "富山県",
        "まいどはやバス",
        "https://opdt.city.toyama.lg.jp/dataset/8de65493-0af7-49d3-aab6-b495fc3ea2b0/resource/43903d9f-1d9c-42f0-bd01-8a5fc1cb828c/download/city-toyama-maidohaya-gtfs.zip",
    ),
    (
        "JPN",
        "奈良県",
        "ぐるっとバス",
        "http://www.pref.nara.jp/secure/204903/GTFS-JP(2021-03-18_1033).zip",
    ),
    (
        "JPN",
        "大分県",
        "コミュニティバス時刻表（中津市全体）",
        "https://www.city-nakatsu.jp/doc/2019072300060/file_contents/GTFS_Nakatsu_city.zip",
    ),
    (
        "JPN",
        "山梨県",
        "山梨県全市町",
        "https://transitfeeds.com/p/yamanashi/813/latest/download",
    ),
    (
        "CMR",
        "Douala",
        "Yellow Taxis",
        "https://development-data-hub-s3-public.s3.amazonaws.com/ddhfiles/1188736/gtfs_yellow_taxis.zip",
    ),
    (
        "CMR",
        "Douala",
        "Socatur Bus",
        "https://development-data-hub-s3-public.s3.amazonaws.com/ddhfiles/1188736/socatur-bus.zip",
    ),
    (
        "MEX",
        "Mexico City",
        "Mexico City GTFS",
        "https://development-data-hub-s3-public.s3.amazonaws.com/ddhfiles/974581/gtfs_semovi_cdmx.zip",
    ),
    (
        "BRA",
        "Porto Alegre",
        "Porto Alegre",
        "https://development-data-hub-s3-public.s3.amazonaws.com/ddhfiles/1188536/gtfs_porto_alegre_2020.zip",
    ),
    (
        "USA",
        "New York",
        "Subway",
        "http://web.mta.info/developers/data/nyct/subway/google_transit.zip",
    ),
    (
        "USA",
        "New York",
        "Bronx",
        "http://web.mta.info/developers/data/nyct/bus/google_transit_bronx.zip",
    ),
    (
        "USA",
        "New York",
        "Queens",
        "http://web.mta.info/developers/data/nyct/bus/google_transit_queens.zip",
    ),
    (
        "USA",
        "New York",
        "Brooklyn",
        "http://web.mta.info/developers/data/nyct/bus/google_transit_brooklyn.zip",
    ),
    (
        "USA",
        "New York",
        "Staten Island",
        "http://web.mta.info/developers/data/nyct/bus/google_transit_staten_island.zip",
    ),
    (
        "USA",
        "New York",
        "Metro North",
        "http://web.mta.info/developers/data/mnr/google_transit.zip",
    ),
    (
        "USA",
        "New York",
        "Bus co.",
        "http://web.mta.info/developers/data/busco/google_transit.zip",
    ),
    (
        "USA",
        "New York",
        "Nassau",
        "http://www.nicebus.com/NiceBus/media/Nicebus-FrontPageNewsImages/To_Google_Merged.zip",
    ),
)
