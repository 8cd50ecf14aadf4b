"""Labels for test and model results. The Chinese texts and the band limits."""

from pyspark.sql import functions as F


def trend_direction(slope):
    return (F.when(slope > 0.001, "上升").when(slope < -0.001, "下降")
            .when(slope.isNotNull(), "平稳"))


def correlation_strength(r):
    size = F.abs(r)
    return (F.when(size < 0.3, "弱相关").when(size < 0.5, "中等相关")
            .when(size < 0.7, "较强相关").when(size.isNotNull(), "强相关"))


def correlation_direction(r):
    return F.when(r > 0, "正相关").when(r.isNotNull(), "负相关")


def ttest_conclusion(p, alpha, group1, group2, mean1, mean2):
    higher = F.when(mean1 > mean2, group1).otherwise(group2)
    return F.when(p < alpha, F.concat(
        F.lit(f"在α={alpha}水平下，两组均值存在显著差异，"), higher.cast("string"),
        F.lit("组的均值更高"))).when(
            p.isNotNull(), F.lit(f"在α={alpha}水平下，两组均值无显著差异"))


def anova_conclusion(p, alpha):
    return (F.when(p < alpha, f"在α={alpha}水平下，各组均值存在显著差异，建议进行事后多重比较")
            .when(p.isNotNull(), f"在α={alpha}水平下，各组均值无显著差异"))


def normality_conclusion(p, alpha):
    return (F.when(p >= alpha, "数据服从正态分布").when(p.isNotNull(), "数据不服从正态分布"))


def premium_irr_conclusion(r, p, alpha):
    direction = F.when(r > 0, "正相关").otherwise("负相关")
    return F.when(p < alpha, F.concat(
        F.lit("保费与IRR之间存在显著的"), direction, F.lit("关系（"), correlation_strength(r),
        F.lit("），相关系数为"), F.format_string("%.3f", r))).when(
            p.isNotNull(), "保费与IRR之间不存在显著的相关关系")


def simple_fit(slope, r2, p, alpha, x, y):
    direction = F.when(slope > 0, "正向").otherwise("负向")
    power = (F.when(r2 < 0.1, "解释力较弱").when(r2 < 0.3, "具有一定的解释力")
             .when(r2 < 0.5, "具有中等解释力").otherwise("具有较强的解释力"))
    return F.when(p >= alpha, F.concat(x, F.lit("对"), y, F.lit("的影响不显著"))).when(
        p.isNotNull(), F.concat(
            x, F.lit("对"), y, F.lit("存在显著的"), direction, F.lit("影响，模型"), power,
            F.lit("(R²="), F.format_string("%.3f", r2), F.lit(")")))


def multiple_fit(r2, f_p, significant, alpha, y):
    fit = (F.when(r2 < 0.3, "拟合效果一般").when(r2 < 0.5, "拟合效果中等")
           .when(r2 < 0.7, "拟合效果较好").otherwise("拟合效果很好"))
    count = F.size(significant)
    return (
        F.when(f_p >= alpha, F.concat(F.lit("整体模型不显著，无法有效解释"), y, F.lit("的变化")))
        .when(f_p.isNotNull() & (count == 0), "模型整体显著但无显著变量，可能存在多重共线性")
        .when(f_p.isNotNull(), F.concat(
            F.lit("模型"), fit, F.lit("，"), count.cast("string"), F.lit("个变量显著影响"), y,
            F.lit("，显著变量: "), F.concat_ws(", ", significant)))
    )


def quality_band(score):
    return (F.when(score >= 90, "excellent").when(score >= 80, "good")
            .when(score >= 60, "warning").when(score.isNotNull(), "poor"))


def quality_advice(score):
    return (F.when(score < 80, "数据质量较低，建议进行数据清洗后再进行分析")
            .when(score < 90, "数据质量一般，建议关注缺失值和异常值处理")
            .otherwise("数据质量良好，可以进行后续分析"))
