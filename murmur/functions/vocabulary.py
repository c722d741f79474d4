"""Class names, severities, tiers, thresholds, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASS_EN = {
    "gunshot": "a gunshot", "explosion": "an explosion", "scream": "a person screaming", "glass_breaking": "glass breaking", "vehicle_crash": "a vehicle crash", "shout_yell": "a person shouting",
    "door_slam": "a door slamming", "running_footsteps": "running footsteps", "siren": "a siren", "alarm_bell": "an alarm bell", "fireworks": "fireworks", "object_drop_dishes": "objects or dishes falling",
    "laughter": "laughter", "applause_cheering": "applause and cheering", "speech_normal": "people talking", "ambient_noise": "ambient background noise",
}
CLASS_VI = {
    "gunshot": "tiếng súng", "explosion": "tiếng nổ", "scream": "tiếng hét hoảng loạn", "glass_breaking": "tiếng kính vỡ", "vehicle_crash": "tiếng va chạm xe", "shout_yell": "tiếng quát tháo",
    "door_slam": "tiếng đóng sập cửa", "running_footsteps": "tiếng bước chân chạy", "siren": "tiếng còi hú", "alarm_bell": "tiếng chuông báo động", "fireworks": "tiếng pháo", "object_drop_dishes": "tiếng rơi vỡ đồ vật",
    "laughter": "tiếng cười", "applause_cheering": "tiếng vỗ tay, reo hò", "speech_normal": "tiếng nói chuyện", "ambient_noise": "tiếng ồn nền",
}
SEVERITY_VI = {"LOW": "thấp", "MEDIUM": "trung bình", "HIGH": "cao", "CRITICAL": "nghiêm trọng"}
AREA_TYPE_VI = {"school": "trường học", "parking": "nhà xe", "residential": "khu dân cư", "factory": "nhà xưởng"}
NO_EVENT_EN, NO_EVENT_VI = "No salient sound event was detected.", "Không phát hiện sự kiện âm thanh đáng chú ý."
NO_CLASS_VI = "không có sự kiện đáng chú ý"
NO_EVIDENCE_VI = "Không tìm thấy sự kiện nào phù hợp với câu hỏi trong khoảng thời gian được hỏi. Hệ thống không suy đoán khi không có bằng chứng."
#: (first hour, last hour, name); other hours are NIGHT_VI.
PARTS_OF_DAY_VI = ((5, 10, "buổi sáng"), (11, 13, "buổi trưa"), (14, 17, "buổi chiều"), (18, 22, "buổi tối"))
NIGHT_VI = "ban đêm"
TIER_WEIGHTS = {"Critical": 1.0, "High": 0.7, "Medium": 0.4, "Negative": 0.05}
#: Least score of each severity; below all of them it is LOW.
SEVERITIES = ((0.80, "CRITICAL"), (0.60, "HIGH"), (0.35, "MEDIUM"))
CONFIDENCE_FLOOR, GROUP_A_ALERT, DETECTION_THRESHOLD = 0.10, 0.60, 0.20
BOUNDARY_FRACTION, BOUNDARY_PAD = 0.5, 0.05
MIN_SIMILARITY, TOP_K = 0.52, 5
PAGE_DEFAULT, PAGE_MOST, UPLOAD_MOST = 50, 200, 100 * 1024 * 1024
NEGATIONS = {"en": ["no", "not", "n't", "without", "never", "absent", "lacks", "lacking", "none", "nothing"], "vi": ["không", "chẳng", "chưa", "không có", "không hề"]}
NEGATION_WINDOW = 4
#: Room size by reverberation time in seconds: (least, name); below the first there is none.
RT60_ROOMS = ((0.2, "small"), (0.5, "medium"), (1.2, "large"))
#: Class sequences with the least and greatest pause before each next member.
CHAINS = {
    "break_in": (("glass_breaking", "scream", "running_footsteps"), ((0.5, 2.0), (0.3, 1.5))),
    "forced_entry": (("door_slam", "shout_yell", "running_footsteps"), ((0.5, 2.0), (0.3, 1.5))),
    "emergency": (("alarm_bell", "shout_yell", "running_footsteps"), ((0.5, 2.5), (0.3, 1.5))),
    "false_alarm_fireworks": (("fireworks", "applause_cheering"), ((0.3, 2.0),)),
    "false_alarm_dishes": (("object_drop_dishes", "laughter"), ((0.3, 2.0),)),
}


def label_classes(classes: list[str]) -> list[str]:
    """Class order of label vectors: sorted, without the background class."""
    return sorted(c for c in classes if c != "ambient_noise")


def tiers(spark: SparkSession, by_class: dict[str, str]) -> DataFrame:
    """(class_id, tier, weight), a row a class."""
    return spark.createDataFrame([(c, t, TIER_WEIGHTS[t]) for c, t in by_class.items()], "class_id string, tier string, weight double")
