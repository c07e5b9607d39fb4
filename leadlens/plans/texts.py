"""The texts of the decision operators, in the order of their rules."""

# Recommendation: strategy, badge, action, and the rationale with its placeholders.
RECOMMENDATIONS = [
    ("DOUBLE DOWN (Scale Spend)", "success",
     "Primary growth engine. Increase monthly marketing budget by 25-35%. Scale CAC budget.",
     "High conversion ({conversion}) and strong post-signing revenue per deal ({revenue})."),
    ("ACCELERATE SDR WORKFLOW", "warning",
     "Shorten sales cycle by assigning senior SDRs and automating lead routing.",
     "Solid conversion ({conversion}) but bottlenecked by slow closing speed ({days} days)."),
    ("OPTIMIZE LANDING PAGE & TARGETING", "info",
     "Redesign top landing pages, tighten lead qualification criteria, and run A/B copy tests.",
     "Low conversion ({conversion}) but high revenue per converted seller ({revenue})."),
    ("DEPRECATE OR REALLOCATE SPEND", "danger",
     "Reduce ad spend by 40% and reallocate capital into Paid Search and Referral.",
     "Sub-par conversion ({conversion}) and low post-signing monetization ({revenue})."),
]

# Anomaly: type, severity, metric with its placeholders, insight, recommendation.
ANOMALIES = [
    ("Volume Trap Anomaly", "HIGH", "MQLs: {mqls} | Conversion: {conversion}",
     "Channel produces high lead volume but severely underperforms in conversion.",
     "Enforce strict MQL lead scoring threshold before sending to SDRs."),
    ("Post-Signing Activation Leakage", "CRITICAL", "Conversion: {conversion} | Activation: {activation}",
     "Sellers sign contracts but fail to list catalog products post-onboarding.",
     "Implement 14-day mandatory Seller Onboarding Concierge program."),
    ("Sales Velocity Bottleneck", "MEDIUM", "Rev/Deal: {revenue} | Days to Close: {days}",
     "High-value leads take over 3 weeks to sign contract.",
     "Provide fast-track contract templates and dedicated SR incentives."),
]

PERFORMANCE_TAGS = ["1. Top Performing (Scale Spend)", "2. High Conv / Slow Speed (Optimize SDR)",
                    "3. Low Conv / High Rev (Fix Landing Page)", "4. Underperforming (Reallocate Spend)"]


def pieces(text: str) -> list[tuple[bool, str]]:
    """A text cut at its placeholders: (is a placeholder, text or name)."""
    out = []
    for k, part in enumerate(text.replace("}", "{").split("{")):
        if part:
            out.append((k % 2 == 1, part))
    return out
