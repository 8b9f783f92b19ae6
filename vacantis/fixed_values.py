"""Fixed values that results depend on: word lists, patterns, tags, limits.

Nothing here is logic. Every list is in its natural order because several rules
are "first entry wins".
"""

# --- fixed values: skill spellings (folded words -> stored spelling) ---------
SKILL_ALIASES = {
    "api integration": "apiIntegration",
    "apis rest": "apiRest",
    "application security": "applicationSecurity",
    "artificial intelligence": "artificialIntelligence",
    "cloud services": "cloudServices",
    "cross platform development": "crossPlatformDevelopment",
    "data modeling": "dataModeling",
    "full stack": "fullStack",
    "github": "github",
    "google maps": "googleMaps",
    "jetpack compose": "jetpackCompose",
    "kubernetes": "kubernetes",
    "laravel": "laravel",
    "microservices": "microservices",
    "mobx": "mobx",
    "mvp": "mvp",
    "ngrx": "ngrx",
    "node js": "nodeJs",
    "nodejs": "nodeJs",
    "offline first": "offlineFirst",
    "openai api": "openAiApi",
    "postgresql": "postgresql",
    "power bi": "powerBi",
    "product management": "productManagement",
    "react native": "reactNative",
    "rest api": "restApi",
    "rpa": "rpa",
    "rxjs": "rxjs",
    "scrum": "scrum",
    "sql": "sql",
    "state management": "stateManagement",
    "ui ux implementation": "uiUxImplementation",
    "websocket": "webSocket",
    "web sockets": "webSocket",
    "workmanager": "workManager",
    "xcode": "xcode",
}

# --- fixed values: display spellings, by compact key -------------------------
DISPLAY_ALIASES = {
    "trabajoenequipo": "Trabajo en equipo",
    "comunicacionefectiva": "Comunicacion efectiva",
    "comunicacinefectiva": "Comunicacion efectiva",
    "resolucindeproblemas": "Resolucion de problemas",
    "pensamientoanalitico": "Pensamiento analitico",
    "aprendizajecontinuo": "Aprendizaje continuo",
    "liderazgo": "Liderazgo",
    "proactividad": "Proactividad",
    "adaptacion": "Adaptacion",
    "apirest": "API REST",
    "nodejs": "Node.js",
    "reactjs": "React.js",
    "net": ".NET",
}

# --- fixed values: compact keys of soft skills -------------------------------
SOFT_SKILL_KEYS = [
    "trabajoenequipo",
    "comunicacionefectiva",
    "comunicacinefectiva",
    "resolucindeproblemas",
    "pensamientoanalitico",
    "aprendizajecontinuo",
    "liderazgo",
    "proactividad",
    "adaptacion",
    "adaptabilidad",
    "colaboracion",
    "comunicacion",
    "disciplina",
    "orientacionallogro",
    "orientacionalresultado",
    "pensamientocritico",
]

# --- fixed values: work-mode keywords, first match wins ----------------------
WORK_MODE_KEYWORDS = {
    "remote": "remote",
    "remoto": "remote",
    "teletrabajo": "remote",
    "hybrid": "hybrid",
    "hibrido": "hybrid",
    "híbrido": "hybrid",
    "presencial": "onsite",
    "onsite": "onsite",
    "office": "onsite",
}

# --- fixed values: known cities, first match wins ----------------------------
KNOWN_CITIES = [
    # Colombia
    "Bogotá", "Medellín", "Cali", "Barranquilla", "Cartagena", "Bucaramanga",
    "Pereira", "Manizales", "Ibagué", "Cúcuta", "Villavicencio", "Pasto",
    "Montería", "Neiva", "Armenia", "Popayán", "Valledupar", "Santa Marta",
    "Sincelejo", "Tunja", "Sabaneta", "Envigado", "Itagüí", "Bello",
    "Rionegro", "Guarne", "Cereté",
    # Chile
    "Santiago", "Valparaíso", "Concepción", "La Serena", "Antofagasta",
    "Temuco", "Rancagua", "Talca", "Arica", "Puerto Montt", "Iquique",
    # Argentina
    "Buenos Aires", "Córdoba", "Rosario", "Mendoza", "La Plata",
    "Mar del Plata", "Tucumán", "Salta", "Santa Fe", "San Juan",
    # Mexico
    "Ciudad de México", "Mexico City", "Guadalajara", "Monterrey", "Puebla",
    "Tijuana", "León", "Juárez", "Mérida", "Querétaro", "Zapopan",
    # Peru
    "Lima", "Arequipa", "Trujillo", "Chiclayo", "Cusco", "Piura",
    # Ecuador
    "Quito", "Guayaquil", "Cuenca", "Ambato",
    # Venezuela
    "Caracas", "Maracaibo", "Valencia", "Barquisimeto",
    # Uruguay
    "Montevideo", "Salto", "Paysandú",
    # Paraguay
    "Asunción", "Ciudad del Este",
    # Bolivia
    "La Paz", "Cochabamba", "Santa Cruz de la Sierra",
    # Costa Rica, Panama, Guatemala
    "San José", "Ciudad de Panamá", "Ciudad de Guatemala",
    # Spain
    "Madrid", "Barcelona", "Valencia", "Sevilla", "Bilbao", "Málaga", "Zaragoza",
    # USA
    "Miami", "New York", "Austin", "San Francisco",
]

# --- fixed values: English-requirement phrases, on folded text ---------------
ENGLISH_NEGATIVE = [
    "no requiere ingles",
    "sin ingles",
    "ingles no requerido",
    "not required in english",
    "english not required",
]
ENGLISH_POSITIVE = [
    "requiere.*ingles",
    "postular en ingles",
    "ingles.*requerid",
    "english required",
    "must be.*english",
    "fluent in english",
    "intermediate english",
    "advanced english",
    "b2 english",
    "english level",
]
ENGLISH_MENTION = ["ingles", "english"]

# --- fixed values: city names looked for in card and detail texts ------------
CARD_CITY_NAMES = [
    "Medellín", "Bogotá", "Cali", "Barranquilla", "Cartagena", "Bucaramanga", "Pereira",
    "Manizales", "Ibagué", "Cúcuta", "Sabaneta", "Guarne", "Envigado", "Itagui",
]
DETAIL_CITY_NAMES = [
    "Bogotá", "Medellín", "Cali", "Barranquilla", "Cartagena", "Bucaramanga", "Pereira",
    "Sabaneta", "Guarne", "Envigado", "Montería", "Cereté",
]
DETAIL_WORK_MODE_WORDS = [
    "remoto", "remote", "teletrabajo", "hibrido", "hybrid", "presencial", "onsite", "office",
]
SALARY_WORDS = ["salario", "convenir"]

# --- fixed values: page markup of the two page families ----------------------
CARD_SITE = "magneto365"
CARD_SITE_URL = "https://www.magneto365.com"
CARD_CONTAINER_CLASS = "magneto-ui-card-jobs_container"
CARD_LINK = "/co/empleos/"
CARD_TITLE_CLASSES = ["text--big", "text--bold"]
DETAIL_DATE_CLASS = "header_publish-date"
DETAIL_COMPANY_CLASS = "header__company"
DETAIL_CONTRACT_CLASS = "contract-type"
DETAIL_LABEL_CLASS = "summary_label"
DETAIL_TEXT_CLASS = "JobOfferDetailContent_content"
DETAIL_SKILL_CLASS = "skill_name"
DETAIL_SKILL_FALLBACK = "skill"
DETAIL_SKILL_FALLBACK_MAX = 50

MICRODATA_SITE = "getonboard"
MICRODATA_SITE_URL = "https://www.getonbrd.com"
MICRODATA_LINK = "/empleos/"
MICRODATA_NOT_LINKS = ["/tag/", "/ciudad/"]
MICRODATA_LINKS_PER_PAGE = 10
MICRODATA_COMPANY_CLASS = "header__company"
MICRODATA_WIFI_CLASS = "icon-wifi"
MICRODATA_TOOLTIP_CLASS = "location-tooltip-content"
MICRODATA_TAG_CLASS = "gb-tags__item"
MICRODATA_BODY_ID = "job-body"

# --- fixed values: parameter bounds ------------------------------------------
SEARCH_LIMIT = (1, 200)
TOP_N = (1, 50)
TOP_N_FLOOR = 10
MONTHS_AHEAD = (1, 12)
TEST_MONTHS = (1, 6)
RECENT_LIMIT = 5000
TOP_CITIES = 5

# --- fixed values: messages of a task ----------------------------------------
TASK_QUEUED = "Scraping encolado"
TASK_RUNNING = "Procesando fuente: "
SOURCE_QUEUED = "Pendiente"
