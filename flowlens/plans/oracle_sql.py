"""DuckDB SQL builders shared by several oracle texts (oracle side only)."""

from __future__ import annotations


def _on(a: str, b: str, cols) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in cols)


def external_ctes(ct: str, g: list[str], out: str = "scores") -> list[tuple[str, str]]:
    """CTEs computing ARI / AMI / V per group ``g`` from ``ct(g..., u, v, n)``.

    EMI is the full hypergeometric sum with ``lgamma`` (no window), so it also
    checks that the windowed Spark sum loses nothing.
    """
    G = ", ".join(g)
    aG = ", ".join(f"a.{c}" for c in g)
    return [
        ("p_a", f"select {G}, u, cast(sum(n) as bigint) as m from {ct} group by all"),
        ("p_b", f"select {G}, v, cast(sum(n) as bigint) as m from {ct} group by all"),
        ("p_ua", f"select {G}, sum(cast(m as double) * m) as sa2, count(*) as R, "
                 f"cast(sum(m) as double) as N, sum(m * ln(m)) as alogA from p_a group by all"),
        ("p_vb", f"select {G}, sum(cast(m as double) * m) as sb2, count(*) as C, "
                 f"sum(m * ln(m)) as blogB from p_b group by all"),
        ("p_cells", f"select {', '.join('c.' + x for x in g)}, sum(cast(c.n as double) * c.n) as sn2, "
                    f"sum(c.n * (ln(c.n) - ln(a.m) - ln(b.m))) as mi_raw from {ct} c "
                    f"join p_a a on {_on('c', 'a', g)} and c.u = a.u "
                    f"join p_b b on {_on('c', 'b', g)} and c.v = b.v group by all"),
        ("p_terms", f"select {aG}, a.m as am, b.m as bm, ua.N as N, "
                    f"unnest(generate_series(greatest(1, a.m + b.m - cast(ua.N as bigint)), least(a.m, b.m))) as k "
                    f"from p_a a join p_b b on {_on('a', 'b', g)} join p_ua ua on {_on('a', 'ua', g)}"),
        ("p_emi", f"select {G}, sum((k / N) * (ln(N) + ln(k) - ln(am) - ln(bm)) * exp("
                  f"lgamma(am + 1) + lgamma(bm + 1) + lgamma(N - am + 1) + lgamma(N - bm + 1) - lgamma(N + 1)"
                  f" - lgamma(k + 1) - lgamma(am - k + 1) - lgamma(bm - k + 1) - lgamma(N - am - bm + k + 1)))"
                  f" as emi from p_terms group by all"),
        ("p_base", f"select {', '.join('ua.' + x for x in g)}, R, C, N, "
                   f"sn2 - N as tp, sb2 - sn2 as fp, sa2 - sn2 as fn, N * N - (sb2 - sn2) - (sa2 - sn2) - sn2 as tn, "
                   f"greatest(mi_raw / N + ln(N), 0) as MI, "
                   f"case when R = 1 then 0.0 else ln(N) - alogA / N end as Hu, "
                   f"case when C = 1 then 0.0 else ln(N) - blogB / N end as Hv, "
                   f"case when R = 1 or C = 1 then 0.0 else coalesce(e.emi, 0.0) end as emi "
                   f"from p_ua ua join p_vb vb on {_on('ua', 'vb', g)} join p_cells c on {_on('ua', 'c', g)} "
                   f"left join p_emi e on {_on('ua', 'e', g)}"),
        ("p_hc", f"select *, case when Hu = 0 then 1.0 else MI / Hu end as hom, "
                 f"case when Hv = 0 then 1.0 else MI / Hv end as com, "
                 f"(Hu + Hv) / 2 - emi as den0 from p_base"),
        (out, f"select {G}, "
              f"case when fn = 0 and fp = 0 then 1.0 else 2.0 * (tp * tn - fn * fp) / "
              f"((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) end as ARI, "
              f"case when R = 1 and C = 1 then 1.0 else (MI - emi) / (case when den0 < 0 then "
              f"least(den0, -2.220446049250313e-16) else greatest(den0, 2.220446049250313e-16) end) end as AMI, "
              f"case when hom + com = 0 then 0.0 else 2 * hom * com / (hom + com) end as V from p_hc"),
    ]


def report_ctes(conf: str, g: list[str]) -> list[tuple[str, str]]:
    """Per-class table ``pc(g..., class, tp, support, predicted, precision, recall, f1_score)``."""
    G = ", ".join(g)
    on = lambda a, b: _on(a, b, g)
    return [
        ("r_cls", f"select distinct {G}, y as c from {conf} union select distinct {G}, p as c from {conf}"),
        ("r_tp", f"select {G}, y as c, sum(n) as tp from {conf} where y = p group by all"),
        ("r_sup", f"select {G}, y as c, sum(n) as support from {conf} group by all"),
        ("r_prd", f"select {G}, p as c, sum(n) as predicted from {conf} group by all"),
        ("pc", f"select {', '.join('k.' + x for x in g)}, k.c as class, cast(coalesce(t.tp, 0) as bigint) as tp, "
               f"cast(coalesce(s.support, 0) as bigint) as support, "
               f"cast(coalesce(q.predicted, 0) as bigint) as predicted from r_cls k "
               f"left join r_tp t on {on('k', 't')} and k.c = t.c "
               f"left join r_sup s on {on('k', 's')} and k.c = s.c "
               f"left join r_prd q on {on('k', 'q')} and k.c = q.c"),
        ("pcm", "select *, case when predicted = 0 then 0.0 else tp / predicted end as precision, "
                "case when support = 0 then 0.0 else tp / support end as recall, "
                "case when support + predicted = 0 then 0.0 else 2.0 * tp / (support + predicted) end as f1_score "
                "from pc"),
    ]


def global_metrics_sql(g: list[str]) -> str:
    G = ", ".join(g)
    return (f"select {G}, round(sum(tp) / sum(support), 9) as accuracy, "
            f"round(avg(case when support > 0 then recall end), 9) as balanced_accuracy, "
            f"round(avg(f1_score), 9) as macroF1, round(sum(f1_score * support) / sum(support), 9) as weightedF1, "
            f"round(case when (sum(support)::double * sum(support) - sum(predicted::double * predicted)) * "
            f"(sum(support)::double * sum(support) - sum(support::double * support)) = 0 then 0.0 else "
            f"(sum(tp)::double * sum(support) - sum(support::double * predicted)) / sqrt("
            f"(sum(support)::double * sum(support) - sum(support::double * support)) * "
            f"(sum(support)::double * sum(support) - sum(predicted::double * predicted))) end, 9) as MCC "
            f"from pcm group by all")
