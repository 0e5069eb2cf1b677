"""Fixed values that results depend on: word lists, labels, prompt wording, limits."""

# Portuguese function words left out of token lists.
STOP_WORDS_PT = """
de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das
tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era
depois sem mesmo aos ter seus quem nas me esse eles você essa num nem suas meu às minha têm numa
pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este dele tu te vocês vos
lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele
aquela aqueles aquelas isto aquilo
""".split()

# Process stage (lower case) to outcome.
STAGE_OUTCOMES = {
    "contratado pela decision": "contratado",
    "contratado como hunting": "contratado",
    "aprovado": "contratado",
    "proposta aceita": "contratado",
    "encaminhar proposta": "contratado",
    "documentação pj": "contratado",
    "documentação clt": "contratado",
    "documentação cooperado": "contratado",
    "não aprovado pelo cliente": "negado",
    "não aprovado pelo rh": "negado",
    "não aprovado pelo requisitante": "negado",
    "recusado": "negado",
    "desistiu": "negado",
    "desistiu da contratação": "negado",
    "sem interesse nesta vaga": "negado",
    "prospect": "em_processo",
    "inscrito": "em_processo",
    "encaminhado ao requisitante": "em_processo",
    "entrevista técnica": "em_processo",
    "entrevista com cliente": "em_processo",
    "em avaliação pelo rh": "em_processo",
}
OUTCOME_UNKNOWN = "vazio"
FIRST_STAGES = ["prospect", "inscrito"]
ADVANCED_OUTCOMES = ["contratado", "em_processo"]
CLOSED_OUTCOMES = ["contratado", "negado"]

# Column roles looked up in a feature map, and their priorities.
DROPPED_ROLES = ["id", "date", "personal_info", "leakage_risk"]
EXCLUDED_ROLES = ["id", "target", "date", "personal_info", "group", "leakage_risk"]
CATEGORY_ROLES = ["vaga_info", "candidato_info"]
EXPECTED_ROLES = [
    "id", "target", "date", "personal_info", "leakage_risk", "vaga_info", "candidato_info", "text",
]
TARGET_PRIORITY = ["target_triagem", "status_simplificado", "target_contratacao"]
GROUP_COLUMNS = ["codigo_vaga", "codigo_applicant"]
JOB_KEYS = ["codigo_vaga"]
CANDIDATE_KEYS = ["codigo_applicant", "codigo_prospect", "id_candidato", "cand_id"]

# Input columns of the screening model.
MODEL_CATEGORIES = [
    "beneficios.valor_compra_1",
    "beneficios.valor_compra_2",
    "beneficios.valor_venda",
    "formacao_e_idiomas.ano_conclusao",
    "formacao_e_idiomas.cursos",
    "formacao_e_idiomas.instituicao_ensino_superior",
    "formacao_e_idiomas.nivel_academico",
    "formacao_e_idiomas.nivel_espanhol",
    "formacao_e_idiomas.nivel_ingles",
    "formacao_e_idiomas.outro_idioma",
    "informacoes_basicas.cliente",
    "informacoes_basicas.empresa_divisao",
    "informacoes_basicas.limite_esperado_para_contratacao",
    "informacoes_basicas.objetivo_vaga",
    "informacoes_basicas.origem_vaga",
    "informacoes_basicas.prazo_contratacao",
    "informacoes_basicas.prioridade_vaga",
    "informacoes_basicas.tipo_contratacao",
    "informacoes_basicas.titulo_vaga",
    "informacoes_basicas.vaga_sap",
    "informacoes_pessoais.download_cv",
    "informacoes_profissionais.area_atuacao",
    "informacoes_profissionais.certificacoes",
    "informacoes_profissionais.conhecimentos_tecnicos",
    "informacoes_profissionais.nivel_profissional",
    "informacoes_profissionais.outras_certificacoes",
    "informacoes_profissionais.remuneracao",
    "informacoes_profissionais.titulo_profissional",
    "infos_basicas.local",
    "modalidade",
    "perfil_vaga.areas_atuacao",
    "perfil_vaga.bairro",
    "perfil_vaga.cidade",
    "perfil_vaga.equipamentos_necessarios",
    "perfil_vaga.estado",
    "perfil_vaga.faixa_etaria",
    "perfil_vaga.habilidades_comportamentais_necessarias",
    "perfil_vaga.horario_trabalho",
    "perfil_vaga.local_trabalho",
    "perfil_vaga.nivel profissional",
    "perfil_vaga.nivel_academico",
    "perfil_vaga.nivel_espanhol",
    "perfil_vaga.nivel_ingles",
    "perfil_vaga.outro_idioma",
    "perfil_vaga.regiao",
    "perfil_vaga.vaga_especifica_para_pcd",
    "perfil_vaga.viagens_requeridas",
]
MODEL_TEXTS = [
    "cv_pt",
    "infos_basicas.objetivo_profissional",
    "perfil_vaga.competencia_tecnicas_e_comportamentais",
    "perfil_vaga.demais_observacoes",
    "perfil_vaga.principais_atividades",
]
JOB_LEVEL = "perfil_vaga.nivel_academico"
CANDIDATE_LEVEL = "formacao_e_idiomas.nivel_academico"
JOB_SKILLS = "perfil_vaga.competencia_tecnicas_e_comportamentais"
CANDIDATE_SKILLS = "informacoes_profissionais.conhecimentos_tecnicos"
JOB_ACTIVITIES = "perfil_vaga.principais_atividades"
CANDIDATE_CV = "cv_pt"

# Decision and size limits.
THRESHOLD = 0.6
WARNING_LIMIT = 30
TOP_K = 5
TOP_K_MAX = 1000
PROMPT_CHARS = 2000
COMMON_QUESTIONS = 5
CANDIDATE_QUESTIONS = 3
DRIFT_ALPHA = 0.05
DRIFT_GATE = 0.30
NO_ID = "sem_id"
NO_CANDIDATES = "Nenhum candidato enviado."

# Wording of the interview prompt.
PROMPT_HEAD = [
    "Você é um recrutador técnico. Gere EXATAMENTE um JSON válido conforme o schema abaixo.",
    "Crie 5 perguntas comuns (iguais para todos) e 3 perguntas personalizadas por candidato.",
    "Perguntas devem ser objetivas, avaliando fit técnico e comportamental.",
    "",
    "SCHEMA:",
    '{"common_questions": ["...", "...", "...", "...", "..."], '
    '"per_candidate": {"<external_id>": ["...", "...", "..."]}}',
    "",
    "VAGA:",
]
PROMPT_TAIL = "Responda apenas com o JSON solicitado. Não inclua explicações adicionais."
