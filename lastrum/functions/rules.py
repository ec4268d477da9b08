"""Rule tables of the procurement domain. All values here are fixed values: results are right only with exactly these."""

from __future__ import annotations

# Unit spellings and their canonical unit.
UNITS = {
    "UN": "UN",
    "UND": "UN",
    "UNID": "UN",
    "UNIDADE": "UN",
    "UNIDADES": "UN",
    "KG": "KG",
    "KILO": "KG",
    "QUILO": "KG",
    "QUILOGRAMA": "KG",
    "QUILOGRAMAS": "KG",
    "L": "L",
    "LT": "L",
    "LITRO": "L",
    "LITROS": "L",
    "M": "M",
    "METRO": "M",
    "METROS": "M",
    "M2": "M2",
    "M²": "M2",
    "METRO QUADRADO": "M2",
    "METROS QUADRADOS": "M2",
    "M3": "M3",
    "M³": "M3",
    "METRO CUBICO": "M3",
    "METROS CUBICOS": "M3",
    "CX": "CX",
    "CAIXA": "CX",
    "CAIXAS": "CX",
    "PC": "PC",
    "PECA": "PC",
    "PECAS": "PC",
    "PEÇA": "PC",
    "PEÇAS": "PC",
    "PCT": "PCT",
    "PACOTE": "PCT",
    "PACOTES": "PCT",
    "FD": "FD",
    "FARDO": "FD",
    "FARDOS": "FD",
    "GL": "GL",
    "GALAO": "GL",
    "GALÃO": "GL",
    "RL": "RL",
    "ROLO": "RL",
    "ROLOS": "RL",
    "FR": "FR",
    "FRASCO": "FR",
    "FRASCOS": "FR",
    "TB": "TB",
    "TUBO": "TB",
    "TUBOS": "TB",
    "SC": "SC",
    "SACO": "SC",
    "SACOS": "SC",
    "PAR": "PAR",
    "PARES": "PAR",
    "CP": "CP",
    "COMPRIMIDO": "CP",
    "COMPRIMIDOS": "CP",
    "AMP": "AMP",
    "AMPOLA": "AMP",
    "AMPOLAS": "AMP",
    "ML": "ML",
    "MILILITRO": "ML",
    "MILILITROS": "ML",
    "G": "G",
    "GRAMA": "G",
    "GRAMAS": "G",
    "CM": "CM",
    "CENTIMETRO": "CM",
    "CENTIMETROS": "CM",
    "TON": "TON",
    "TONELADA": "TON",
    "TONELADAS": "TON",
    "SERVICO": "SV",
    "SERVIÇO": "SV",
    "SV": "SV",
    "MES": "MES",
    "MÊS": "MES",
    "MENSAL": "MES",
    "DIARIA": "DIA",
    "DIÁRIA": "DIA",
    "DIA": "DIA",
    "HORA": "HR",
    "HR": "HR",
    "H": "HR",
}

# Regional synonyms for all states, in order of application.
SYNONYMS = {
    "ACUDE": "RESERVATORIO",
    "CACIMBA": "POCO",
    "AGUADA": "RESERVATORIO",
    "CISTERNAS": "CISTERNA",
    "TANQUE DE PEDRA": "RESERVATORIO",
    "BARRAGEM": "RESERVATORIO",
    "OLEO DIESEL S10": "DIESEL S10",
    "GASOLINA TIPO C": "GASOLINA COMUM",
    "ETANOL HIDRATADO": "ETANOL",
    "ALCOOL ETILICO": "ETANOL",
    "CARNE DE SOL": "CARNE BOVINA",
    "CHARQUE": "CARNE BOVINA",
    "CARNE SECA": "CARNE BOVINA",
    "JACUBA": "FARINHA DE MANDIOCA",
    "GOMA DE TAPIOCA": "TAPIOCA",
    "POLVILHO AZEDO": "POLVILHO",
    "POLVILHO DOCE": "POLVILHO",
    "BEIJU": "TAPIOCA",
    "PAÇOCA DE PILAO": "AMENDOIM",
    "RAPADURA": "ACUCAR",
    "MELADO": "ACUCAR",
    "FARINHA DE MILHO": "FUBA",
    "ANGU": "FUBA",
    "CUSCUZ": "FUBA",
    "AGUA RAS": "SOLVENTE",
    "QUEROSENE": "COMBUSTIVEL",
    "VASSOURA DE PALHA": "VASSOURA",
    "VASSOURA DE PIAÇAVA": "VASSOURA",
    "RODO DUPLO": "RODO",
    "ESCOVAO": "VASSOURA",
    "BOTA DE BORRACHA": "BOTA DE SEGURANCA",
    "CHAPEU DE PALHA": "CHAPEU DE PROTECAO",
    "MACACÃO": "MACACAO",
    "MACACAO DE TRABALHO": "MACACAO",
    "AVENTAL DE RASPA": "AVENTAL",
    "PROTETOR AURICULAR": "PROTETOR AURICULAR",
    "ADOBE": "TIJOLO",
    "TELHA COLONIAL": "TELHA",
    "TELHA DE BARRO": "TELHA",
    "PEDRA MARROADA": "BRITA",
    "PEDRA BRITADA": "BRITA",
    "CACO DE TIJOLO": "MATERIAL DE CONSTRUCAO",
    "CAL HIDRATADA": "CAL",
    "REBOCO PAULISTA": "REBOCO",
    "ROÇAGEM": "LIMPEZA DE TERRENO",
    "ROCAGEM": "LIMPEZA DE TERRENO",
    "CAPINA": "LIMPEZA DE TERRENO",
    "LIMPEZA DE BOCAS DE LOBO": "SERVICO DE LIMPEZA",
    "DESJEJUM": "CAFE DA MANHA",
    "RANCHO": "ALIMENTACAO",
    "REFEICAO": "ALIMENTACAO",
    "MARMITA": "ALIMENTACAO",
    "CARTUCHO DE TINTA ORIGINAL": "CARTUCHO DE TINTA",
    "TONER COMPATIVEL": "TONER",
    "TONER REMANUFATURADO": "TONER",
    "IMPRESSORA MATRICIAL": "IMPRESSORA",
    "IMPRESSORA LASER": "IMPRESSORA",
    "PAPEL A4 75GR": "PAPEL A4",
    "PAPEL A4 75G": "PAPEL A4",
    "PAPEL A4 90GR": "PAPEL A4",
    "PAPEL SULFITE A4": "PAPEL A4",
    "PAPEL COPIA": "PAPEL A4",
    "SORO FISIOLOGICO": "SOLUCAO FISIOLOGICA",
    "SF 0,9%": "SOLUCAO FISIOLOGICA",
    "DIPIRONA SODICA": "DIPIRONA",
    "PARACETAMOL 500MG": "PARACETAMOL",
    "AMOXICILINA 500MG": "AMOXICILINA",
    "ALGODAO HIDROFILO": "ALGODAO",
    "ATADURA CREPE": "ATADURA",
    "ESPARADRAPO": "FITA ADESIVA HOSPITALAR",
}

# Further synonyms of single states.
STATE_SYNONYMS = {
    "BA": {
        "ABARA": "CUZCUZ DE FEIJAO",
        "VATAPÁ": "VATAPA",
        "ACARAJE": "BOLINHO DE FEIJAO",
    },
    "PE": {
        "SURURU": "MEXILHAO",
        "MOCOTO": "JOELHO BOVINO",
    },
    "CE": {
        "CUMBU": "RAPADURA",
        "PAÇOCA": "AMENDOIM TORRADO",
    },
    "PA": {
        "AÇAI": "ACAI",
        "TUCUMÃ": "TUCUMA",
        "PUPUNHA": "FRUTO PUPUNHA",
    },
    "AM": {
        "CASTANHA DO PARA": "CASTANHA DO BRASIL",
        "TUCUMÃ": "TUCUMA",
        "PIRARUCU": "PEIXE PIRARUCU",
    },
    "RS": {
        "CHIMIA": "GELEIA",
        "CUCAS": "BOLO COLONIAL",
        "NATA": "CREME DE LEITE",
    },
    "SC": {
        "CUCA": "BOLO COLONIAL",
        "SALAME COLONIAL": "SALAME",
    },
    "MG": {
        "QUITANDA": "PRODUTOS DE PADARIA",
        "PA DE QUEIJO": "PAO DE QUEIJO",
    },
    "GO": {
        "EMPADAO GOIANO": "EMPADAO",
        "ARAGUAIA": "PEIXE ARAGUAIA",
    },
    "MT": {
        "PACU": "PEIXE PACU",
        "PINTADO": "PEIXE PINTADO",
    },
}

# Noise phrases in descriptions, in order of removal.
NOISE = (
    r"\bCONFORME\s+EDITAL\b",
    r"\bDE\s+ACORDO\s+COM\s+O\s+EDITAL\b",
    r"\bDEMAIS\s+ESPECIFICA[ÇC][OÕ]ES\b",
    r"\bCONFORME\s+TERMO\s+DE\s+REFER[EÊ]NCIA\b",
    r"\bVIDE\s+EDITAL\b",
    r"\bCONFORME\s+DESCRI[ÇC][AÃ]O\s+COMPLETA\b",
    r"\bCONFORME\s+ESPECIFICA[ÇC][OÕ]ES\b",
    r"\bVER\s+ANEXO\b",
    r"\bOBS\.?:?\s*$",
    r"\bCONFORME\s+ESPECIFICA[ÇC][OÕ]ES\s+T[EÉ]CNICAS\b",
    r"\bDE\s+ACORDO\s+COM\s+EDITAL\b",
    r"\bCONFORME\s+MEMORIAL\s+DESCRITIVO\b",
    r"\bOU\s+SIMILAR\b",
    r"\bOU\s+EQUIVALENTE\b",
)

# Number and unit rewrites, in order.
NUMBERS = (
    (r"(\d)\.(\d{3})\s*(ML|G|KG|L|M|CM)\b", r"\1\2 \3"),
    (r"(\d+)\s*GR\b", r"\1 G"),
    (r"(\d+)\s*ML\b", r"\1 ML"),
    (r"(\d+)\s*G\b", r"\1 G"),
    (r"(\d+)\s*L\b", r"\1 L"),
    (r"(\d+)\s*KG\b", r"\1 KG"),
    (r"(\d+)\s*CM\b", r"\1 CM"),
    (r"(\d+)\s*M\b(?!M|L|2|3|²|³)", r"\1 M"),
)

# Patterns of attributes in upper-case descriptions.
ATTRIBUTES = {
    "marca": r"\bMARCA\s*:?\s*([A-Z0-9][A-Z0-9 ]{1,30})\b",
    "modelo": r"\bMODELO\s*:?\s*([A-Z0-9][A-Z0-9\- ]{1,30})\b",
    "capacidade": r"(\d+[\.,]?\d*)\s*(ML|L|G|KG|M|CM|M2|M3|TON)\b",
    "volume": r"(\d+[\.,]?\d*)\s*(ML|L|LITRO|LITROS)\b",
    "dimensao": r"(\d+[\.,]?\d*)\s*[Xx×]\s*(\d+[\.,]?\d*)\s*(?:[Xx×]\s*(\d+[\.,]?\d*))?\s*(CM|M|MM)?",
    "material": r"\b(ACO|AÇO|INOX|PLASTICO|PLÁSTICO|MADEIRA|MDF|VIDRO|ALUMINIO|ALUMÍNIO|PVC|NYLON|POLIETILENO|BORRACHA|LATEX|LÁTEX|NITRILA|COURO|TECIDO|ALGODAO|ALGODÃO)\b",
    "unidade_embalagem": r"\b(CAIXA|CX|PACOTE|PCT|FARDO|FD|ROLO|RL|FRASCO|FR|GALAO|GALÃO|GL|SACO|SC)\s+COM\s+(\d+)",
    "quantidade_embalagem": r"\b(\d+)\s*(UN|UND|UNIDADE|UNIDADES|FOLHAS?|FL)\s*/\s*(CAIXA|CX|PACOTE|PCT|FARDO|FD|ROLO|RL)",
}

# Classifier rules, first match first: pattern, category, whether the main term matches.
RULES = (
    (r"\bPAPEL\s+(SULFITE\s+)?A4\b", "Papel A4", True),
    (r"\bPAPEL\s+(SULFITE\s+)?OFICIO\b", "Papel A4", True),
    (r"\bPAPEL\s+(PARA\s+)?COPIA\b", "Papel A4", True),
    (r"\bPAPEL\s+SULFITE\b", "Papel A4", True),
    (r"\bPAPEL\s+REPROGRAFIA\b", "Papel A4", True),
    (r"\bPAPEL\s+XEROX\b", "Papel A4", True),
    (r"\bPAPEL\s+IMPRESSAO\b", "Papel A4", True),
    (r"\bPAPEL\b.*\b(75\s*G|75\s*GR|90\s*G|90\s*GR)\b", "Papel A4", False),
    (r"\bDETERGENTE\b", "Detergente", True),
    (r"\bMULTIUSO\b", "Detergente", False),
    (r"\bLIMPADOR\b", "Detergente", False),
    (r"\bLIMPA\s+VIDRO\b", "Detergente", False),
    (r"\bDESENTUPIDOR\b", "Detergente", False),
    (r"\bDESENGORDURANTE\b", "Detergente", False),
    (r"\bSABAO\b", "Detergente", False),
    (r"\bSABONETE\b", "Detergente", False),
    (r"\bALCOOL\s*GEL\b", "Álcool Gel", True),
    (r"\bDESINFETANTE\b", "Desinfetante", True),
    (r"\bHIPOCLORITO\b", "Desinfetante", False),
    (r"\bAGUA\s+SANITARIA\b", "Desinfetante", False),
    (r"\bVASSOURA\b", "Detergente", False),
    (r"\bRODO\b", "Detergente", False),
    (r"\bBALDE\b", "Detergente", False),
    (r"\bPANO\s*(DE\s+)?CHAO\b", "Detergente", False),
    (r"\bESPONJA\b", "Detergente", False),
    (r"\bGASOLINA\s+ADITIVADA\b", "Gasolina Comum", True),
    (r"\bGASOLINA\s+COMUM\b", "Gasolina Comum", True),
    (r"\bGASOLINA\b", "Gasolina Comum", True),
    (r"\bETANOL\b", "Etanol", True),
    (r"\bOLEO\s+DIESEL\b", "Diesel S10", True),
    (r"\bDIESEL\s*S[\s-]*10\b", "Diesel S10", True),
    (r"\bDIESEL\s*S[\s-]*500\b", "Diesel S10", False),
    (r"\bARLA\b", "Diesel S10", False),
    (r"\bGNV\b", "Etanol", False),
    (r"\bTONER\s+COMPATIVEL\b", "Toner para Impressora", True),
    (r"\bTONER\s+ORIGINAL\b", "Toner para Impressora", True),
    (r"\bTONER\b", "Toner para Impressora", True),
    (r"\bCARTUCHO\s*(DE\s+)?TINTA\b", "Cartucho de Tinta", True),
    (r"\bCARTUCHO\s+HP\b", "Cartucho de Tinta", False),
    (r"\bCARTUCHO\s+EPSON\b", "Cartucho de Tinta", False),
    (r"\bCARTUCHO\s+CANON\b", "Cartucho de Tinta", False),
    (r"\bRIBBON\b", "Toner para Impressora", False),
    (r"\bREFIL\s*(DE\s+)?TINTA\b", "Cartucho de Tinta", False),
    (r"\bARROZ\s*(TIPO)?\b", "Arroz", True),
    (r"\bFEIJAO\b", "Feijão", True),
    (r"\bACUCAR\b", "Açúcar", True),
    (r"\bSAL\s+REFINADO\b", "Açúcar", False),
    (r"\bOLEO\s*(DE\s+)?SOJA\b", "Óleo de Soja", True),
    (r"\bLEITE\s*(INTEGRAL)?\b", "Leite", True),
    (r"\bFUBA\b", "Arroz", False),
    (r"\bMACAR[RR]AO\b", "Arroz", False),
    (r"\bFARINHA\s*(DE\s+)?TRIGO\b", "Arroz", False),
    (r"\bSERVICO\s*(DE\s+)?LIMPEZA\b", "Serviço de Limpeza", True),
    (r"\bLIMPEZA\s+PREDIAL\b", "Serviço de Limpeza", True),
    (r"\bCONSERVACAO\s*(E\s+)?LIMPEZA\b", "Serviço de Limpeza", False),
    (r"\bASSEIO\s*(E\s+)?CONSERVACAO\b", "Serviço de Limpeza", False),
    (r"\bPNEU\s*\d{3}\s*/\s*\d{2}\b", "Bota de Segurança", False),
    (r"\bPNEU\s*(ARO|R)\s*\d+\b", "Bota de Segurança", False),
    (r"\bCAMARA\s*(DE\s+)?AR\b", "Bota de Segurança", False),
    (r"\bCAPACETE\b", "Capacete de Segurança", True),
    (r"\bBOTA\s*(DE\s+)?SEGURANCA\b", "Bota de Segurança", True),
    (r"\bLUVA\s*(DE\s+)?NITRILA\b", "Luva de Procedimento", True),
    (r"\bCOLETE\s*(DE\s+)?SINALIZAD?OR\b", "Bota de Segurança", False),
    (r"\bOCULOS\s*(DE\s+)?PROTECAO\b", "Bota de Segurança", False),
    (r"\bUNIFORME\b", "Uniforme Escolar", True),
    (r"\bCAMISA\s+SOCIAL\b", "Uniforme Escolar", False),
    (r"\bCADEIRA\s*(DE\s+|PARA\s+)?ESCRITORIO\b", "Cadeira de Escritório", True),
    (r"\bMESA\s*(DE\s+|PARA\s+)?ESCRITORIO\b", "Mesa de Escritório", True),
    (r"\bARMARIO\s*(DE\s+|EM\s+)?ACO\b", "Armário de Aço", True),
    (r"\bESTANTE\s*(DE\s+|EM\s+)?ACO\b", "Estante Metálica", True),
    (r"\bARQUIVO\s*(DE\s+|EM\s+)?ACO\b", "Armário de Aço", False),
    (r"\bCOMPUTADOR\b.*\bI[3579]\b", "Computador Desktop", True),
    (r"\bNOTEBOOK\b.*\bI[3579]\b", "Notebook", True),
    (r"\bMONITOR\b.*\b\d{2}\s*\"?\b", "Monitor", True),
    (r"\bTECLADO\b.*\bMOUSE\b", "Computador Desktop", False),
    (r"\bNOBREAK\b", "Nobreak/UPS", True),
    (r"\bSWITCH\b.*\b\d+\s*PORTA\b", "Switch de Rede", True),
)

# Rules of the batch classifier, in the same form.
BATCH_RULES = (
    (r"\bPAPEL\s+(SULFITE\s+)?A4\b", "Papel A4", True),
    (r"\bPAPEL\s+(SULFITE\s+)?OFICIO\b", "Papel A4", True),
    (r"\bPAPEL\s+(PARA\s+)?COPIA\b", "Papel A4", True),
    (r"\bPAPEL\s+SULFITE\b", "Papel A4", True),
    (r"\bPAPEL\s+REPROGRAFIA\b", "Papel A4", True),
    (r"\bPAPEL\s+XEROX\b", "Papel A4", True),
    (r"\bPAPEL\s+IMPRESSAO\b", "Papel A4", True),
    (r"\bPAPEL\b.*\b(75\s*G|75\s*GR|90\s*G|90\s*GR)\b", "Papel A4", False),
    (r"\bDETERGENTE\b", "Material de Limpeza Geral", True),
    (r"\bSABAO\b|\bSABONETE\b", "Material de Limpeza Geral", False),
    (r"\bALCOOL\s*GEL\b|\bALCOOL\s*70\b", "Material de Limpeza Geral", True),
    (r"\bDESINFETANTE\b|\bHIPOCLORITO\b|\bAGUA\s+SANITARIA\b", "Material de Limpeza Geral", True),
    (r"\bVASSOURA\b|\bRODO\b|\bBALDE\b|\bESPONJA\b|\bPANO\s*(DE\s+)?CHAO\b", "Material de Limpeza Geral", False),
    (r"\bLIMP(A|ADOR|EZA)\b", "Material de Limpeza Geral", False),
    (r"\bPISCINA\b", "Material de Limpeza Geral", False),
    (r"\bGASOLINA\b", "Combustível (Gasolina / Etanol / Diesel)", True),
    (r"\bETANOL\b|\bALCOOL\s+COMBUSTIVEL\b", "Combustível (Gasolina / Etanol / Diesel)", True),
    (r"\bDIESEL\b|\bOLEO\s+DIESEL\b", "Combustível (Gasolina / Etanol / Diesel)", True),
    (r"\bARLA\s*32\b", "Combustível (Gasolina / Etanol / Diesel)", False),
    (r"\bTONER\b", "Cartucho / Toner", True),
    (r"\bCARTUCHO\b", "Cartucho / Toner", True),
    (r"\bRIBBON\b|\bREFIL\s*(DE\s+)?TINTA\b", "Cartucho / Toner", False),
    (r"\bARROZ\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bFEIJAO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bACUCAR\b|\bAZUCAR\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bFARINHA\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bOLEO\s+(DE\s+)?SOJA\b|\bOLEO\s+VEGETAL\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bMASS[AÃ]\s*ALIMENTICIA\b|\bMACAR\b|\bMACARRAO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bSAL\s+(DE\s+)?COZINHA\b|\bSAL\s+REFINADO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bCAFE\s+(EM\s+)?PO\b|\bCAFE\s+TORRADO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bLEITE\s+(EM\s+)?PO\b|\bLEITE\s+(INTEGRAL|DESNATADO)\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bMERENDA\s+ESCOLAR\b|\bCESTA\s+BASICA\b|\bKIT\s+ALIMENT\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bAGUA\s+MINERAL\b|\bAGUA\s+POTAVEL\b", "Água Mineral", True),
    (r"\bGALAO\s+(DE\s+)?AGUA\b|\bGARRAFAO\b", "Água Mineral", False),
    (r"\bGAS\s+(DE\s+)?COZINHA\b|\bGLP\b|\bGAS\s+LIQUEFEITO\b", "Gás de Cozinha (GLP)", True),
    (r"\bBOTIJAO\s+(DE\s+)?GAS\b|\bBOTIJAO\s+GLP\b", "Gás de Cozinha (GLP)", True),
    (r"\bCANETA\b|\bLAPIS\b|\bBORRACHA\b|\bREGUA\b|\bCOMPASSO\b", "Material de Expediente Geral", True),
    (r"\bCLIPE\b|\bGRAMPEADOR\b|\bGRAMPO\b|\bPERFURADOR\b", "Material de Expediente Geral", True),
    (r"\bENVELOPE\b", "Envelopes e Formulários", True),
    (r"\bETIQUETA\b", "Material de Expediente Geral", False),
    (r"\bFITA\s+ADESIVA\b|\bDURATAPE\b|\bFITA\s+CREPE\b", "Material de Expediente Geral", False),
    (r"\bCOMPUTADOR\b|\bDESKTOP\b|\bMICROCOMPUTADOR\b", "Computador Desktop", True),
    (r"\bNOTEBOOK\b|\bLAPTOP\b", "Computador Desktop", True),
    (r"\bIMPRESSORA\b", "Impressora", True),
    (r"\bNOBREAK\b|\bUPS\b|\bFONTE\s+(DE\s+)?ENERGIA\b", "Nobreak / UPS", True),
    (r"\bFIO\s+ELETRICO\b|\bCABO\s+ELETRICO\b|\bFIO\s+COBRE\b", "Material Elétrico", True),
    (r"\bDISJUNTOR\b|\bTOMBEAR\b|\bTOMADA\b|\bINTERRUPTOR\b", "Material Elétrico", True),
    (r"\bLAMPADA\b|\bLED\s+\d+W\b|\bLAMPADA\s+LED\b", "Material Elétrico", True),
    (r"\bELETRICO\b|\bELETRICAL\b", "Material Elétrico", False),
    (r"\bCANO\s+PVC\b|\bTUBO\s+PVC\b|\bCOTOVELO\b|\bJOELHO\b|\bTEE\s+PVC\b", "Material Hidráulico", True),
    (r"\bREGISTRO\s+(DE\s+)?AGUA\b|\bVALVULA\b|\bTORNEIRA\b", "Material Hidráulico", True),
    (r"\bMESA\s+(DE\s+)?(ESCRITORIO|REUNIAO|TRABALHO)\b", "Mesa / Cadeira de Escritório", True),
    (r"\bCADEIRA\s+(DE\s+)?(ESCRITORIO|GIRATORIA|PLASTICA)\b", "Mesa / Cadeira de Escritório", True),
    (r"\bARMARIO\b|\bARQUIVO\s+(DE\s+)?ACO\b", "Armário / Arquivo", True),
    (r"\bMOBILIARIO\s+ESCOLAR\b|\bCARTEIRA\s+ESCOLAR\b|\bBELICHE\b", "Mobiliário Escolar", True),
    (r"\bEPI\b|\bEQUIPAMENTO\s+(DE\s+)?PROTECAO\b|\bCAPA\s+DE\s+CHUVA\b", "EPI (Equipamento de Proteção Individual)", True),
    (r"\bLUVA\s+(DE\s+)?NITRILA\b|\bLUVA\s+CIRURGICA\b|\bLUVA\s+LATEX\b", "EPI (Equipamento de Proteção Individual)", True),
    (r"\bMASCARA\s+(CIRURGICA|N95|PFF2)\b", "EPI (Equipamento de Proteção Individual)", True),
    (r"\bCAPACETE\b|\bBOTA\s+(DE\s+)?(BORRACHA|SEGURANCA)\b", "EPI (Equipamento de Proteção Individual)", True),
    (r"\bMEDICAMENTO\b|\bFARMACO\b|\bCOMPRIMIDO\b|\bCAPS[UÚ]LA\b", "Medicamentos Básicos (OTC)", True),
    (r"\bFARMACIA\b|\bDROGARIA\b", "Medicamentos Básicos (OTC)", False),
    (r"\bSERINGA\b|\bAGULHA\s+HIPOD\b|\bGAZE\b|\bATALHO\b|\bESTETOSCOPIO\b", "Material Hospitalar / Descartáveis Médicos", True),
    (r"\bCATETER\b|\bSONDA\b|\bDRENO\b", "Material Hospitalar / Descartáveis Médicos", True),
    (r"\bCAMERA\s+(DE\s+)?SEGURANCA\b|\bCFTV\b|\bDOME\s+CAMERA\b|\bBULLET\s+CAMERA\b", "Câmera de Segurança (CFTV)", True),
    (r"\bDVR\b|\bNVR\b", "DVR / NVR", True),
    (r"\bDRONE\b|\bVANT\b|\bUAV\b", "Drone / UAV", True),
    (r"\bINSTRUMENTO\s+MUSICAL\b|\bVIOLAO\b|\bGUITARRA\b|\bTECLADO\s+MUSICAL\b", "Instrumento Musical", True),
    (r"\bCIMENTO\b", "Cimento / Areia / Brita", True),
    (r"\bARE(I|Ã)A\s+(GROSSA|FINA|MEDIA)\b|\bBRITA\b", "Cimento / Areia / Brita", True),
    (r"\bKIT\s+(DE\s+)?PRIMEIROS?\s+SOCORROS\b|\bDEFIBRILADOR\b", "Kit de Primeiros Socorros", True),
    (r"\bTRAJE\s+(DE\s+)?ESPORT\b|\bCHUTEIRA\b|\bBOLA\s+DE\b|\bCHUTEIRA\b|\bKIT\s+ESPORT\b", "Material Esportivo", True),
    (r"\bCABO\s+HDMI\b|\bCABO\s+VGA\b|\bCABO\s+USB\b|\bCABO\s+REDE\b", "Material Elétrico", False),
    (r"\bRJ45\b|\bPATCH\s+CORD\b|\bCABO\s+UTP\b|\bCABO\s+CAT5\b|\bCABO\s+CAT6\b", "Material Elétrico", False),
    (r"\bCABO\s+DE\s+FORCA\b|\bCABO\s+DE\s+REDE\b", "Material Elétrico", False),
    (r"\bPARAFUSADEIRA\b|\bFURADEIRA\b|\bSERRA\b|\bMARTELO\b|\bCHAVE\s+DE\b", "Material Elétrico", False),
    (r"\bABRACAdEIRA\b|\bABRACADEIRA\b|\bARRUELA\b|\bPARAFUSO\b|\bPORC[AÃ]\b", "Material Hidráulico", False),
    (r"\bCONECTOR\b|\bADAPTADOR\b", "Material Elétrico", False),
    (r"\bCARNE\s+BOVINA\b|\bCARNE\s+SUINA\b|\bCARNE\s+DE\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bFRANGO\b|\bPEITO\s+DE\s+FRANGO\b|\bCOXA\b|\bFRANGO\s+INTEIRO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bBACON\b|\bAPRESUNTADO\b|\bLINGUICA\b|\bSALSICHA\b|\bPRESUNTO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bCOSTELA\b|\bPALETA\s+(BOVINA|SUINA|DESOSSADA)\b|\bPES\s+SUINOS\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bMARGARINA\b|\bMANTEIGA\b|\bEXTRATO\s+DE\s+TOMATE\b|\bSARDINHA\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bACHOCOLATADO\b|\bNESQUIK\b|\bLEITE\s+CONDENSADO\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bBOLACHA\b|\bBISCOITO\b|\bMIPIPOCA\b|\bMILHO\s+DE\s+PIPOCA\b|\bPIPOCA\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bSAQUINHO\s+PARA\s+PIPOCA\b|\bPALITO\s+PARA\s+ALGODAO\b", "Gêneros Alimentícios (Merenda Escolar)", False),
    (r"\bCAFE\s+\d+\s*(G|GR|KG)\b|\bCAFE\s+PACOTE\b", "Gêneros Alimentícios (Merenda Escolar)", True),
    (r"\bESTABILIZADOR\s+DE\s+TENSAO\b|\bESTABILIZADOR\s+\d+\s*VA\b", "Nobreak / UPS", True),
    (r"\bAUTOTRANSFORMADOR\b|\bTRANSFORMADOR\s+DE\s+VOLTAGEM\b", "Nobreak / UPS", False),
    (r"\bFILTRO\s+DE\s+LINHA\b|\bFILTRO\s+ANTI\s*PICO\b", "Nobreak / UPS", False),
    (r"\bPEN\s+DRIVE\b|\bPENDRIVE\b|\bFLASH\s+USB\b", "Computador Desktop", False),
    (r"\bADAPTADOR\s+WI.?FI\b|\bWI.?FI\s+USB\b|\bWI.?FI\s+NANO\b", "Computador Desktop", False),
    (r"\bCARTAO\s+DE\s+VISITA\b|\bADESIVO\s+PARA\s+CAMPANHA\b|\bADESIVOS\b", "Material de Expediente Geral", False),
    (r"\bALMOFADA\s+PARA\s+CARIMBO\b|\bCAMBO\b|\bREFORCO\s+AUTO\b|\bREFORCO\s+ADESIVO\b", "Material de Expediente Geral", False),
    (r"\bESTILETE\b|\bTESOURA\b", "Material de Expediente Geral", False),
    (r"\bCAMISETA\b|\bCAMISA\b|\bCONJUNTO\s+UNIFORME\b|\bUNIFORME\b", "EPI (Equipamento de Proteção Individual)", False),
    (r"\bPADRAO\s+TRIFASICO\b|\bPADRAO\s+MONOFASICO\b|\bBIFASICO\b", "Material Elétrico", False),
    (r"\bCAPA\s+\d+\s*/\s*\d+SN\b|\bCAPA\s+[0-9½¾]+\b", "Material Hidráulico", False),
    (r"\bENGENHARIA\s+DE\s+SEGURANCA\b|\bMEDICINA\s+DO\s+TRABALHO\b|\bPPCMSO\b|\bPGR\b", "EPI (Equipamento de Proteção Individual)", False),
)

# Catalogue codes with category and confidence.
CATALOGUE = {
    27995: ("Computador Desktop", 0.95),
    44103: ("Computador Desktop", 0.90),
    27880: ("Notebook", 0.95),
    26077: ("Monitor", 0.95),
    26093: ("Impressora", 0.95),
    44811: ("Câmera de Segurança", 0.90),
    26123: ("Switch de Rede", 0.90),
    27464: ("Software e Licenças", 0.85),
    26263: ("Nobreak/UPS", 0.90),
    44906: ("Projetor Multimídia", 0.90),
    16884: ("Papel A4", 0.95),
    16602: ("Papel A4", 0.90),
    16578: ("Caneta Esferográfica", 0.95),
    16667: ("Toner para Impressora", 0.95),
    16616: ("Cartucho de Tinta", 0.95),
    16659: ("Envelope", 0.90),
    21181: ("Detergente", 0.95),
    21210: ("Álcool Gel", 0.95),
    21199: ("Papel Higiênico", 0.95),
    21236: ("Desinfetante", 0.95),
    21244: ("Saco de Lixo", 0.90),
    19054: ("Arroz", 0.95),
    19062: ("Feijão", 0.95),
    19100: ("Leite", 0.95),
    19127: ("Óleo de Soja", 0.95),
    19038: ("Açúcar", 0.95),
    24902: ("Cadeira de Escritório", 0.90),
    24910: ("Mesa de Escritório", 0.90),
    24937: ("Armário de Aço", 0.90),
    24945: ("Estante Metálica", 0.90),
    24953: ("Carteira Escolar", 0.85),
    15121: ("Gasolina Comum", 0.95),
    15130: ("Diesel S10", 0.95),
    15148: ("Etanol", 0.95),
    22590: ("Luva de Procedimento", 0.95),
    22616: ("Seringa Descartável", 0.95),
    22632: ("Medicamento Genérico", 0.80),
    22640: ("Máscara Cirúrgica", 0.95),
    22574: ("Material Odontológico", 0.85),
    28055: ("Cimento Portland", 0.95),
    28063: ("Tinta Acrílica", 0.90),
    28080: ("Tubo PVC", 0.90),
    28098: ("Fio Elétrico", 0.90),
    28101: ("Lâmpada LED", 0.90),
    3883: ("Serviço de Limpeza", 0.90),
    3891: ("Serviço de Vigilância", 0.90),
    3468: ("Serviço de TI", 0.85),
    3476: ("Serviço de Manutenção Predial", 0.85),
    3484: ("Serviço de Transporte", 0.85),
    22152: ("Uniforme Escolar", 0.85),
    22160: ("Bota de Segurança", 0.90),
    22178: ("Capacete de Segurança", 0.90),
}

# Monthly variation of the consumer price index in per cent, from January 2020.
IPCA_START = (2020, 1)
IPCA = (
    0.21, 0.25, 0.07, -0.31, -0.38, 0.26, 0.36, 0.24, 0.64, 0.86, 0.89, 1.35,
    0.25, 0.86, 0.93, 0.31, 0.83, 0.53, 0.96, 0.87, 1.16, 1.25, 0.95, 0.73,
    0.54, 1.01, 1.62, 1.06, 0.47, 0.67, -0.68, -0.36, -0.29, 0.59, 0.41, 0.62,
    0.53, 0.84, 0.71, 0.61, 0.23, -0.08, 0.12, 0.23, 0.26, 0.24, 0.28, 0.56,
    0.42, 0.83, 0.16, 0.38, 0.46, 0.21, 0.38, -0.02, 0.44, 0.56, 0.39, 0.52,
    0.16, 1.31, 0.56, 0.43, 0.36, 0.22, 0.30, 0.28, 0.35, 0.42, 0.38, 0.48,
    0.39, 0.72, 0.45,
)

# Factor of each unit to the base unit of its quantity.
UNIT_FACTORS = {
    "L": ("volume", 1.0), "ML": ("volume", 0.001), "KL": ("volume", 1000.0),
    "KG": ("massa", 1.0), "G": ("massa", 0.001), "MG": ("massa", 0.000001), "TON": ("massa", 1000.0),
    "M": ("comprimento", 1.0), "CM": ("comprimento", 0.01), "MM": ("comprimento", 0.001), "KM": ("comprimento", 1000.0),
}
BASE_UNITS = {"volume": "L", "massa": "KG", "comprimento": "M"}

# Points of a source by its kind of price.
SOURCE_POINTS = {"HOMOLOGADO": 30, "TABELA_OFICIAL": 25, "ESTIMADO": 15, "MERCADO": 10}

# Stop words of the search, without accents.
STOP_WORDS = tuple("de da do das dos em no na nos nas a o os as e um uma uns umas para por com que se ao".split())

# Words by which the kind of object is inferred; the classes in brackets are part of the rule.
SERVICE = "(servi[c?]o|manuten[c?][a?]o|loca[c?][a?]o|consultoria|suporte|limpeza|transporte|vigil[?a]ncia|portaria|dedetiza[c?][a?]o|reprografia|telefonia|internet)"
WORKS = "(obra|engenharia|reforma|pavimenta[c?][a?]o|constru[c?][a?]o|edifica[c?][a?]o|drenagem|terraplanagem)"

# Coefficients of the polynomial for the normal distribution (Abramowitz and Stegun 26.2.17).
NORMAL_T, NORMAL_D = 0.2316419, 0.3989422804014327
NORMAL_POLY = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
